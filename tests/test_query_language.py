from hypothesis import given
from hypothesis import strategies as st

from colloquy.operators.query import Query, date_literal, parse


def test_prefixes_and_text():
    q = parse('source:ChatGPT tag:backend kind:decision project:"Project Atlas" after:2024-01-02 has:open_loops register:work redis cache')
    assert q.all("source") == ("chatgpt",) and q.all("tag") == ("backend",) and q.all("kind") == ("decision",)
    assert q.all("project") == ("Project Atlas",) and q.last("after") == date_literal("2024-01-02") and q.all("has") == ("open_loops",)
    assert q.all("register") == ("work",) and q.text == "redis cache"


def test_dates():
    assert date_literal("1970-01-02") == 86400 and date_literal("1970-1-2T0:01:02") == 86462
    assert [date_literal(x) for x in ("1970-13-01", "1970-01-01T25:00:00", "70-01-01", "1970-01-01 00:00", "")] == [None] * 5
    q = parse("after:2024-01-02 after:2024-01-05 after:never")
    assert q.last("after") == date_literal("2024-01-05")


def test_unknown_prefix_is_text_and_invalid_values_drop():
    q = parse("foo:bar kind:nonsense has:nothing after:yesterday see http://x.y")
    assert q.filters == {} and q.last("after") is None
    assert q.text == "foo:bar see http://x.y"


def test_empty():
    assert parse("") == parse(None) == Query()


@given(st.text(alphabet="abc: \"", max_size=40))
def test_never_raises(text):
    parse(text)
