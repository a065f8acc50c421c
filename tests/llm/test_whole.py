"""Cases in which an operator once did less than its whole job."""
import pyarrow as pa
import pytest

from ledgerflow.llm import adaptive_rules, chosen_path, html_mss, quote_links
from ledgerflow.llm.common import written


@pytest.mark.parametrize("name", ["script", "SCRIPT", "style", "textarea"])
def test_raw_elements_end_at_their_end_tag(name):
    """A '<' before a letter, a quote or a comment in a raw element hides no text after it."""
    for inside in ("for(var i=0;i<n;i++){f(i);}", "if (a<b && c == \"'\") g();", "<!-- x", "a </b> </scripty> <i"):
        page = f"<body><{name} type=x>{inside}</{name.lower()} ><article><p>first words here</p></article><{name}>open"
        assert [x for x in html_mss.pieces(page) if x[1]] == [("", "first words here")]
        assert html_mss.extract(page, {}) == "first words here"


def test_long_words_keep_their_language(spark):
    """Fences of a group whose quartiles lie far above 4000 hold its own texts; others still fail."""
    text = lambda k, size: " ".join(chr(0x4E00 + (k * 31 + i * 7) % 9000) * (size + (k + i) % 9) for i in range(12))
    rows = [(k, text(k, 60), "zh", "web") for k in range(40)] + [(100, text(3, 700), "zh", "web"), (101, text(3, 2), "zh", "web")]
    rows += [(200 + k, text(k, 5), "en", "web") for k in range(40)] + [(300, text(3, 60), "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = written(adaptive_rules.measure(docs), "measured")
    assert measured.where("lang = 'zh' and doc_id < 100").agg({"__q.word_length": "min"}).first()[0] > 4000
    got = {r.doc_id for r in adaptive_rules.judge(measured).where("__kept").collect()}
    assert got == {*range(40), *range(200, 240)}


def test_deeper_and_short_quotes_link(spark):
    long = "This is the first long message of all."
    rows = [(1, 0, "u", long), (1, 1, "v", "Fine by me."), (1, 2, "u", "Nothing quoted in this one."),
            (1, 3, "v", f">> {long}\nonly the inner quote is left"), (1, 4, "u", "> Fine by me.\nthanks"),
            (1, 5, "u", f"> Nothing quoted in this one.\n>> {long}\nboth"),
            (2, 3, "u", f">>> {long}\nfrom afar"), (2, 7, "u", "> Fine by me.\nshort, from afar")]
    links = quote_links.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(x.conv_id, x.turn): (x.parent_conv, x.parent_turn, x.n_linked) for x in links}
    assert got[1, 3] == (1, 0, 1) and got[1, 4] == (1, 1, 1)
    assert got[1, 5] == (1, 2, 1)  # the shallowest level that links
    assert got[2, 3] == (1, 0, 1) and got[2, 7] == (None, None, 0)


@pytest.mark.parametrize("count", range(6))
def test_shingles_of_few_words(spark, count):
    """Texts of 0 to 5 words, alone in a slice."""
    text = " ".join(["one", "two", "three", "four", "five"][:count])
    alone = chosen_path.shingle_sets(pa.array([text]), 5)
    beside = chosen_path.shingle_sets(pa.array([text, "a b c d e f g h"]), 5)
    assert len(alone[0]) == min(count, 1) and alone[0].tolist() == beside[0].tolist()


def test_near_duplicates_of_few_words(spark):
    rows = [(i, " ".join("abcde"[:1 + i // 2])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(10, "doc_id")
    assert len(docs.collect()) == 10 and chosen_path.deduplicate(docs).count() == 5
