import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import chat

MARKS = st.text(alphabet=st.sampled_from(list("<|\\>im_startend\n ab")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\\nb\n<|"]), MARKS), max_size=6))
def test_turns_read_back(turns):
    text, spans = chat.compiled(chat.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat.turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_language():
    run = lambda s, **v: chat.compiled(s)(v)[0]
    assert run("{% for x in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[1, 2, 3]) == "1,2,3"
    assert run("{% set a = 1 + 2 * 3 %}{{ a }}{# no #}{% if a == 7 and 'x' in 'xyz' %}yes{% elif b %}b{% else %}no{% endif %}") == "7yes"
    assert run("a  {%- if true -%}  b  {%- endif -%}  c") == "abc"
    assert run("{{ m.a[0].b | upper | trim }}|{{ m.missing }}|{{ m['a'] | length }}", m={"a": [{"b": " q "}]}) == "Q||1"
    assert run("{{ 'x' ~ 1 ~ none ~ true }}") == "x1true"


def test_constants_fold():
    assert chat.fold(chat._Parser("'a' ~ 'b' | upper").whole()) == ("constant", "aB")
    assert chat.fold(chat._Parser("1 + 2 * 3 == 7").whole()) == ("constant", True)
    assert chat.fold(chat._Parser("[1, 'a']").whole()) == ("constant", [1, "a"])


@pytest.mark.parametrize("source", ["{{ }}", "{% if x %}", "{% endfor %}", "{{ x | nothing }}", "{{ x( }}", "{% import os %}", "{{ 1 1 }}", "{% else %}"])
def test_bad_templates(source):
    with pytest.raises(chat.TemplateError):
        chat.compiled(source)


DEEP = ["(" * 3000 + "1" + ")" * 3000, "[" * 3000 + "]" * 3000, "-" * 3000 + "1", "not " * 3000 + "1", "1" + " + 1" * 9000, "x" + ".a" * 9000, "x" + " | trim" * 9000]


@pytest.mark.parametrize("source", [*("{{ " + e + " }}" for e in DEEP), "{% if x %}" * 2000 + "{% endif %}" * 2000, "{{ 'a }}", "{% if x", "a {# b", "{{ x | first }}{{"])
def test_too_deep_or_not_closed(source):
    with pytest.raises(chat.TemplateError):
        chat.compiled(source)


@pytest.mark.parametrize("source", ["{{ 1 % 0 }}", "{{ x % 0 }}", "{{ x | first }}", "{{ x | length }}", "{{ 'a' - 1 }}", "{{ 'a' * 3 }}", "{{ x < 'a' }}", "{{ [1] in 'a' }}", "{% for a in x %}{% endfor %}"])
def test_values_that_do_not_fit(source):
    render = chat.compiled(source)
    with pytest.raises(chat.TemplateError):
        render({"x": 5})


def test_short_circuit():
    run = lambda s, **v: chat.compiled(s)(v)[0]
    assert run("{{ true or (1 % 0) }}{{ false and (1 % 0) }}{{ x or (1 % 0) }}", x=3) == "truefalse3"
    assert run("{{ 0 or x }}{{ 1 and x }}", x="y") == "yy"
    assert run("{% if false %}{{ 1 % 0 }}{% endif %}ok") == "ok"
    assert chat.fold(chat._Parser("true or (1 % 0)").whole()) == ("constant", True)


def test_strings_may_hold_what_closes_a_block():
    run = lambda s, **v: chat.compiled(s)(v)[0]
    assert run("""{{ '}}' }}|{{ "%}" ~ '{{' }}|{% if x == '%}' %}yes{% endif %}""", x="%}") == "}}|%}{{|yes"


def test_sandbox():
    assert chat.compiled("{{ x.__class__ }}{{ x['__init__'] }}")({"x": "text"})[0] == ""
    assert chat.compiled("{{ x.keys }}")({"x": {"a": 1}})[0] == ""


def test_odd_conversations(spark):
    data = [(1, 1, "assistant", None), (1, 0, None, "hi"), (2, 5, "assistant", "<|im_end|>\n"), (2, None, "user", ""), (None, 0, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "y" * 300_000)]
    c = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(1) for k in ("spans", "formatted", "n_turns")})
    out = {r.conv_id: r for r in chat.digests(chat.formatted(c)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].n_turns == 2 and out[1].turns_sha256 == sha("\nhi\nassistant\n\n") and out[1].loss_chars == 0 and out[1].loss_sha256 == sha("")
    assert out[2].turns_sha256 == sha("user\n\nassistant\n<|im_end|>\n\n") and out[2].loss_sha256 == sha("<|im_end|>\n")
    assert out[3].n_turns == 2 and out[None].n_turns == 1 and out[4].loss_chars == 300_000
    assert chat.digests(chat.formatted(c.where("false"))).collect() == []


def test_probe_conversation(spark, small):
    row = chat.op2_chat_formatting(spark, small).where("conv_id = -1").first()
    assert row.n_turns == 2 and row.loss_chars == len(chat.PROBE)
    assert row.loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()
