"""Every query and stage on awkward tables and on empty ones."""
import pytest

import __spark_entry__ as E
import corpus_pipeline
from ledgerflow.llm import adaptive_rules, catalog, ftrl, html_mss, piece_bpe, trigram_secrets, wu_manber
from ledgerflow.llm.common import written
from oracle_check import duck


def test_registered():
    assert set(catalog.QUERIES) < set(E.queries()) and "pipeline" in E.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_on_awkward_rows(spark, folders, name):
    at = folders["rows"]
    got = E.queries()[name](spark, at)
    rows = got.collect()
    op = name.split("_")[0]
    source = spark.read.parquet(f"{at}/{ {'op1': 'conversations', 'op8': 'pages', 'op13': 'conversations'}.get(op, 'documents') }.parquet")
    if op != "op11":  # phrases; all others have a row for each row, op13 for each conversation
        assert len(rows) == (source.select("conv_id").distinct() if op == "op13" else source).count()
    # repeated ids would be one vertex in the SQL of op6, which has a table with unique ids below
    if name in catalog.ORACLE and name != "op6_chosen_path":
        want = duck(at).execute(catalog.ORACLE[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in rows)


@pytest.mark.parametrize("name", [*sorted(set(catalog.QUERIES) - {"op6_chosen_path"}), "pipeline"])  # op6 runs in pipeline
def test_query_on_no_rows(spark, folders, name):
    assert E.queries()[name](spark, folders["none"]).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stage_on_awkward_rows(spark, folders, clashing, stage):
    _, f = corpus_pipeline.STAGES[stage]
    out = f(spark, clashing, folders["rows"])
    assert out.count() <= clashing.count()
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == clashing.columns
        assert {r.score for r in out.select("score").collect()} <= {"mine"}


def test_clashing_names(spark, clashing, folders):
    """Operators leave other columns alone."""
    bench = spark.read.parquet(folders["rows"] + "/benchmark.parquet")
    labels = spark.read.parquet(folders["rows"] + "/labels.parquet")
    pages = spark.read.parquet(folders["rows"] + "/pages.parquet").withColumnRenamed("url", "text").withColumnRenamed("page_id", "tag")
    n = clashing.count()
    outs = [trigram_secrets.scan(clashing), wu_manber.mark(clashing, bench), piece_bpe.encode(clashing),
            adaptive_rules.judge(written(adaptive_rules.measure(clashing), "m")),
            ftrl.score(clashing, (0.0, *ftrl.fit(clashing, labels, labels["doc_id"] > 0)[1:]))]
    for out in outs:
        rows = out.collect()
        assert len(rows) == n and all(r["component"] == "mine" and r["label"] == "mine" for r in rows)
    assert html_mss.extract_pages(pages, {}).count() == pages.count()


def test_pipeline(spark, folders):
    rows = corpus_pipeline.run(spark, folders["rows"]).collect()
    # 9 and the empty ones fail the rules, 2 and 12 copy 1, 1 holds a benchmark window
    assert {r.doc_id for r in rows} <= {6, 7, 10, None}
    assert all(r.n_tokens == len(r.ids) for r in rows)
