from lexmill.llm import decontaminate as D

ITEM = "Each morning the young seller puts 3 apples next to 5 pears on his small table and then waits for people who pass by and may want to buy some fruit for their lunch break today"


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in D.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_numbers_that_become_equal_and_one_edited(spark):
    twice = ITEM.replace("5 pears", "3 pears")
    docs = [(1, ITEM.replace("3", "4").replace("5", "4")), (2, twice.replace("3 pears", "6 pears")), (3, twice.replace("3", "9"))]
    assert found(spark, docs, [(7, ITEM), (8, twice)]) >= {(1, 7), (2, 8), (3, 8), (1, 8), (3, 7)}


def test_one_name_for_three_still_counts_against(spark):
    item = "Sometimes our neighbour Anna feeds the cats while Anna waters those plants because Anna likes it"
    assert found(spark, [(1, item.replace("Anna", "Clara")), (2, item.replace("Anna", "Clara", 1).replace("Anna", "Olga", 1))], [(5, item)]) == {(1, 5)}


def test_mostly_numbers(spark):
    items = [(1, "Compute 17 * 23 + 5"), (2, "2 4 8 16 32 64, next?"), (3, "12 13"), (4, "x = 5"), (5, "- + !")]
    docs = [(1, "So we read here: compute 17 * 23 + 5 and more of it"), (2, "Then 2 4 8 16 32 64, next? was asked"), (3, "Compute 17 + 23 * 5"), (4, "2 4 8 16 32 65, next?"), (5, "in 12 13 and x = 5 - + !"), (6, "12 14 x = 6")]
    assert found(spark, docs, items) == {(1, 1), (2, 2), (5, 3), (5, 4)}
