"""Main-text extraction by a maximum-scoring subsequence over a page's words and tags.

A page is a sequence of text runs and tags. A word scores up to ``WORD``, less (below 0 too) where
labelled pages show that words after the same tag stand outside the article; a tag scores a learned
weight, negative for tags that stand outside. One linear scan
(Kadane's) finds the contiguous region with the greatest total; equal totals keep the earlier,
shorter region. Inside it, elements that never hold main text (``DROPPED``) are left out, and the
rest becomes blocks: white space inside a block is one space, blocks are joined by two newlines.

Labels: a page that marks its article by one ``<article>`` element labels its own tags, inside or
outside. The weights come from the ``SAMPLE`` such pages with the smallest hash of their url and
html (a bound, not a share): a tag's weight is the log odds of standing inside, scaled by
``TAG_SCALE`` and at most ``TAG_MOST``; a word's is the log odds of words after that tag, between
-``WORD`` and ``WORD``; only words score positive. Counting is a partial aggregate over tag
names, of which the ``TAGS`` commonest are kept; the table is broadcast. Extraction is narrow: one
pass over whole pages without shuffle.

Defined results: null, empty and markup-only pages give the empty string; text outside any tag
counts as text; an unclosed comment, script, style or tag runs to the end of the page; a quote that
no other one closes ends no tag; very long pages are read in linear time; repeated pages each get
their row; without labelled pages every tag scores ``UNKNOWN``; other columns pass through.
"""
from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import slices, table, with_struct

SAMPLE = 5_000
TAGS = 500
WORD = 1.0
TAG_SCALE = 40.0
TAG_MOST = -0.01
UNKNOWN = -1.0

#: Elements without main text (fixed values of HTML).
DROPPED = frozenset("""script style noscript template head title nav header footer aside form button
select textarea option iframe object svg canvas menu dialog""".split())
#: Elements whose content is not markup (fixed values of HTML).
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements that start and end a block (fixed values of HTML).
BLOCKS = frozenset("""address article blockquote body dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6
hr html li main ol p pre section table tbody td tfoot th thead tr ul details summary""".split())
#: Elements without content (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class or id attributes of notices, adverts, sidebars and reader comments.
NOTICE = re.compile(r"""\b(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|comments?|cookie\w*|"""
                    r"""consent|notice|popup|modal|newsletter|share|social|related|breadcrumbs?|menu|nav\w*|footer|header)\b""", re.I)

# An attribute value is quoted only where a quote follows the equals sign; without its second half a
# quote is a character like others. Possessive repeats never go back, so a tag is read once.
_VALUE = r"""=[ \t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|)"""
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|"
                  + re.sub(r"\((?=[^?])", "(?:", _VALUE) + r")*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=/>"']++)[ \t\n\f\r]*+""" + _VALUE)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def noticed(attributes: str) -> bool:
    """Whether the class or id among a tag's attributes names a notice."""
    if not NOTICE.search(attributes):
        return False
    return any(m[1].lower() in ("class", "id") and NOTICE.search(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes))


def pieces(page: str) -> Iterator[tuple[str, str]]:
    """(tag, "") and ("", text) in page order; tags as ``name``, ``/name`` or ``name.notice``.
    The content of raw elements is left out, comments and declarations too."""
    at, m = 0, _TAG.search(page)
    while m:
        if m.start() > at:
            yield "", page[at:m.start()]
        at = m.end()
        if m[2] and not m[4]:
            return
        if m[2]:
            name = m[2].lower()
            yield ("/" + name if m[1] else name + ".notice" if m[3] and noticed(m[3]) else name), ""
            if not m[1] and name in RAW and not m[3].rstrip().endswith("/"):
                # no tags in here: a "<" of a script may swallow its end tag
                end = _RAW_END[name].search(page, at)
                if not end or page.find(">", end.end()) < 0:
                    return
                at = end.start()
        m = _TAG.search(page, at)
    if at < len(page):
        yield "", page[at:]


def region(page: str, weights: dict[str, float]) -> list[tuple[str, str]]:
    """The contiguous run of pieces with the greatest score."""
    seq = list(pieces(page))
    best, best_span, total, start = 0.0, (0, 0), 0.0, 0
    last = ""
    for i, (tag, text) in enumerate(seq):
        if tag:
            total, last = total + weights.get(tag, UNKNOWN), tag
        else:
            total += weights.get(f"{last} word", WORD) * len(_WORDS.findall(text))
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_span = total, (start, i + 1)
    return seq[best_span[0]:best_span[1]]


def blocks(seq: list[tuple[str, str]]) -> str:
    """The text of pieces, block by block."""
    out: list[str] = []
    now: list[str] = []
    closed: list[str] = []  # names of open elements inside a dropped one
    held: Counter[str] = Counter()  # how often each name stands in there

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(now))).strip(" ")
        if text:
            out.append(text)
        now.clear()

    for tag, text in seq:
        if closed:
            name = tag.lstrip("/").removesuffix(".notice")
            if tag.startswith("/"):
                while held[name]:
                    last = closed.pop()
                    held[last] -= 1
                    if last == name:
                        break
            elif tag and name not in VOID and (name in DROPPED or name == closed[0]):
                closed.append(name)
                held[name] += 1
            continue
        if not tag:
            now.append(text)
            continue
        name = tag.lstrip("/").removesuffix(".notice")
        if name in BLOCKS or name in DROPPED:
            end()
        elif name == "br":
            now.append(" ")
        if not tag.startswith("/") and name not in VOID and (name in DROPPED or tag.endswith(".notice")):
            closed.append(name)
            held[name] += 1
    end()
    return "\n\n".join(out)


def extract(page: str | None, weights: dict[str, float]) -> str:
    return blocks(region(page, weights)) if page else ""


def _tag_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        counts: dict[str, list[int]] = {}
        for page in part.column("html").to_pylist():
            whole = list(pieces(page))
            seq = [tag for tag, _ in whole]
            if seq.count("article") != 1 or "/article" not in seq:
                continue
            a, b = seq.index("article"), seq.index("/article")
            last = ""
            for i, (tag, text) in enumerate(whole):
                if tag:
                    counts.setdefault(tag, [0, 0])[a < i < b] += 1
                    last = tag
                else:
                    counts.setdefault(f"{last} word", [0, 0])[a < i < b] += len(_WORDS.findall(text))
        yield pa.RecordBatch.from_pydict({"tag": pa.array(list(counts), pa.string()),
                                          "outside": pa.array([c[0] for c in counts.values()], pa.int64()),
                                          "inside": pa.array([c[1] for c in counts.values()], pa.int64())})


def fit(pages: DataFrame, *, column: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Tag weights from at most ``sample`` pages that mark their article themselves."""
    chosen = (pages.select(F.col(column).alias("html")).where(F.col("html").contains("<article"))
              .select("html", F.xxhash64("html").alias("place")))
    keys = chosen.select("place").orderBy("place").limit(sample)
    counts = (chosen.join(F.broadcast(keys.distinct()), "place").dropDuplicates(["place"]).select("html")
              .mapInArrow(_tag_counts, "tag string, outside long, inside long")
              .groupBy("tag").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
              .orderBy(F.desc(F.col("outside") + F.col("inside")), "tag").limit(TAGS).collect())
    total_in, total_out = sum(r.inside for r in counts) + 1, sum(r.outside for r in counts) + 1

    def weight(r) -> float:
        if r.tag.endswith(" word"):
            return max(-WORD, min(WORD, math.log((r.inside + 0.5) / (r.outside + 0.5))))
        odds = math.log((r.inside + 0.5) / total_in) - math.log((r.outside + 0.5) / total_out)
        return min(TAG_MOST, TAG_SCALE * odds)

    return {r.tag: weight(r) for r in counts}


def extract_pages(pages: DataFrame, weights: dict[str, float], *, column: str = "html", name: str = "__main") -> DataFrame:
    """``pages`` plus a struct column ``name`` with ``text``."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def work(values: pa.Array) -> dict[str, pa.Array]:
        return {"text": pa.array([extract(p, shared.value) for p in values.to_pylist()], pa.string())}

    return with_struct(pages, column, name, T.StructType([T.StructField("text", T.StringType())]), work)


def op8_html_mss(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    weights = fit(pages)
    return extract_pages(pages, weights).select("page_id", "url", F.col("__main.text").alias("text"),
                                                F.length("__main.text").cast("long").alias("n_chars"))
