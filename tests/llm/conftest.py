"""Small awkward tables: nulls in any column, empty and very long texts, ties, repeated rows,
extra columns whose names clash with the operators' own."""
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASH = ("score", "kept", "row", "cls", "label", "n", "key", "mask", "rank", "g0", "component", "n_words", "place")

PROSE = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
         "sixteen seventeen eighteen nineteen twenty")
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(15_000))


def texts():
    return [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, "en", None), (4, "", None, "a"),
        (5, " \n\t ", "en", "b"), (6, LONG, "en", "b"), (None, PROSE + " more", "en", "b"), (None, None, None, None),
        (7, 'x password = "abcdefgh12" AKIA' + "A" * 20 + " " + "0123456789abcdef" * 3, "de", "a"),
        (8, "é漢😀   \x00 </p> ▁▁ ﬁ", "fr", "a"), (9, "short", "en", "a"), (10, "you idiot " + PROSE, "en", "a"),
        (11, LONG + " tail", "en", "b"), (12, PROSE.upper(), "en", "c"),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in texts()], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("mine").alias(c) for c in CLASH))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def folders(spark, docs, no_docs, tmp_path_factory):
    """Two folders with tables: awkward rows, and no rows."""
    out = {}
    for name, d in (("rows", docs), ("none", no_docs)):
        at = str(tmp_path_factory.mktemp(name))
        keep = name == "rows"
        tables = {
            "documents": d,
            "benchmark": spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve thirteen"), (2, None), (2, "short"),
                                                (None, "sixteen, SEVENTEEN")][:99 if keep else 0], "item_id long, text string"),
            "labels": spark.createDataFrame([(1, 1, 0), (2, 1, 0), (10, 0, 1), (10, 0, 0), (None, 1, 1), (6, None, None), (7, 1, 0)][:99 if keep else 0],
                                            "doc_id long, quality int, toxic int"),
            "pages": spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "plain words only"), (3, "u", PAGE), (3, "u", PAGE),
                                            (4, "u", "<script>var a = '</p>'"), (5, "u", "<!-- open"), (6, "u", "<p>" + LONG)][:99 if keep else 0],
                                           "page_id long, url string, html string"),
            "conversations": spark.createDataFrame([(1, 0, "user", PROSE), (1, 1, "bot", f"> {PROSE}\n\nthank you for all of that"), (None, 1, None, PROSE),
                                                    (1, 1, "bot", f"> {PROSE}\n\nthank you for all of that"), (2, None, "user", None), (3, 0, "user", ""),
                                                    (4, 7, "user", f"Ann wrote:\n> > thank you for all of that\n> {PROSE.upper()}\nend")][:99 if keep else 0],
                                                   "conv_id long, turn long, role string, text string"),
        }
        for t, df in tables.items():
            df.write.parquet(f"{at}/{t}.parquet")
        out[name] = at
    return out


PAGE = ('<html><head><title>T &amp; U</title><style>p{}</style></head><body><nav><a href="/x">home page</a></nav><div class="ad">buy this now</div>'
        "<article><h1>Head &amp; shoulders</h1><p><b>one two   three\nfour.<br>five six<p>seven eight nine</p></article>"
        "<footer>&copy; somebody else here and there</footer>")
