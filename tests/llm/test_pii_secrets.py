import random

import pytest

from lexmill.llm import pii

KEY = b"key of the tests"
R = random.Random(6)
HEX = "".join(R.choice("0123456789abcdef") for _ in range(200))
LONG = "".join(R.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(3001)) + "9=="
JWT = ".".join("".join(R.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-") for _ in range(n)) + "7" for n in (36, 120, 43))


@pytest.mark.parametrize("value", [HEX, LONG, JWT, "Corr3ct.Horse!Battery$Staple", "abc123=def456:ghi789", "pässwört1geheim2"])
@pytest.mark.parametrize("form", ["password={}", 'token = "{}"', "secret: {}.", "?token={}&page=secondpage"])
def test_whole_value_is_replaced(value, form):
    p, text = pii.Pseudonyms(KEY), f"Before {form.format(value)} after"
    out, found = p.text(text)
    at = text.index(value)
    assert [k for k, _, _ in found] == ["secret"] and found[0][2] == at + len(value)
    new = out[at : at + len(value)]
    assert out == text.replace(value, new) and p.text(out, back=True)[0] == text
    assert not any(value[k : k + 12] == new[k : k + 12] for k in range(0, len(value) - 11))  # nothing stays in clear


def test_quoted_to_the_quote():
    p = pii.Pseudonyms(KEY)
    out = p.text('token="abc123&(def456),ghi7" then')[0]
    assert not any(x in out for x in ("abc123", "def456", "ghi7")) and out.endswith('" then')
