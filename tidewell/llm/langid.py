"""Language identification of web pages by fusing independent evidence with Bayes' rule.

Evidence: likelihoods of the page's text under trigram models of each language; the
language that its markup declares, through how often each language is so declared; and
a prior for its host, smoothed towards its domain's, that towards the address
suffix's, and that towards all pages'. Every count comes from grouped sums.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged
from .shingles import lowered
from .textarrays import pieces, text_buffer

#: Bits of a trigram's bucket.
GRAM_BITS = 14
#: All of a text's trigrams count, by their mean; its weight against other evidence grows up to so many of them, as neighbours are
#: far from independent.
CERTAIN = 150
#: Pseudo-counts with which each level of the address leans on the one above.
LEAN = 5.0
#: Pseudo-counts of each pair of a language and a declaration.
DECLARED = 1.0
#: Languages that country suffixes stand for, and the pseudo-counts they lend their suffix.
COUNTRY = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv", "ru": "ru", "jp": "ja", "cn": "zh"}
COUNTRY_COUNT = 3.0

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)
_HTML_LANG = re.compile(r"<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,8})", re.I)
_META_LANG = re.compile(r"<meta\b[^>]*?http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,8})", re.I)
_HOST = re.compile(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", re.I)

_LUT = np.arange(256, dtype=np.uint32)
_LUT[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def visible_text(page: str | None) -> str:
    return html_lib.unescape(_DROP.sub(" ", page or ""))


def declared_language(page: str | None) -> str | None:
    found = _HTML_LANG.search(page or "") or _META_LANG.search(page or "")
    return found[1].lower() if found else None


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower().strip(".") if found else ""


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bucket and row of each position of lower-cased text; none of blanks alone or across rows."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _LUT[buf]
    at = np.flatnonzero((c[:-2] != 0x20) | (c[1:-1] != 0x20))
    row = np.searchsorted(offs, at, side="right") - 1
    keep = at + 3 <= offs[row + 1]
    at, row = at[keep], row[keep]
    mixed = (c[at] << np.uint32(16) | c[at + 1] << np.uint32(8) | c[at + 2]) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(32 - GRAM_BITS)).astype(np.int64), row


def fit_models(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and log-probabilities of the trigram buckets under each.

    Learnt from all rows whose ``lang`` is known: tasks count, and a sum for each language and bucket meets in the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            names, inverse = np.unique(np.array(b.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            buf, offs = text_buffer(lowered(b.column("text")))
            for i, j in pieces(offs):
                gram, row = grams(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                found = np.bincount((inverse[i + row] << GRAM_BITS) + gram, minlength=len(names) << GRAM_BITS).reshape(len(names), -1)
                for name, n in zip(names.tolist(), found, strict=True):
                    total[name] = total[name] + n if name in total else n
        for name, n in total.items():
            gram = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram, pa.int32()), pa.array(n[gram])], names=["lang", "gram", "n"])

    rows = known.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in rows})
    counts = np.full((len(languages), 1 << GRAM_BITS), 0.5)
    where = {x: i for i, x in enumerate(languages)}
    for r in rows:
        counts[where[r.lang], r.gram] += r.n
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True))


_EVIDENCE = "page_id long, host string, domain string, suffix string, declared string, n_grams long, text_logs array<double>"


def page_evidence(pages: DataFrame, models: np.ndarray) -> DataFrame:
    """What each page says of itself; its text's log-likelihoods are scaled to CERTAIN trigrams at most."""
    held = pages.sparkSession.sparkContext.broadcast(models)  # 16,384 numbers a language
    k = len(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = held.value
        for b in batches:
            for at in range(0, b.num_rows, 200):
                some = b.slice(at, 200)
                bodies = some.column("html").to_pylist()
                hosts = [host_of(u) for u in some.column("url").to_pylist()]
                labels = [h.split(".") for h in hosts]
                buf, offs = text_buffer(lowered(pa.array([visible_text(x) for x in bodies], pa.string())))
                n, sums = np.zeros(len(bodies)), np.zeros((len(bodies), k))
                for i, j in pieces(offs):
                    gram, row = grams(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    n += np.bincount(i + row, minlength=len(bodies))
                    for lang in range(k):
                        sums[:, lang] += np.bincount(i + row, logs[lang][gram], minlength=len(bodies))
                sums *= np.minimum(1, CERTAIN / np.maximum(n, 1))[:, None]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("page_id").cast(pa.int64()),
                        pa.array(hosts),
                        pa.array([".".join(x[-2:]) for x in labels]),
                        pa.array([x[-1] for x in labels]),
                        pa.array([declared_language(x) for x in bodies], pa.string()),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (len(bodies) + 1) * k, k), pa.int32()), pa.array(sums.ravel())),
                    ],
                    names=[x.split()[0] for x in _EVIDENCE.split(", ")],
                )

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, _EVIDENCE)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, not once an element of what ``use`` goes through."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _normal(logs: Column) -> Column:
    """Probabilities from logs, for an array of logs."""
    weights = _once(F.struct(logs.alias("x"), F.array_max(logs).alias("top")), lambda s: F.transform(s["x"], lambda x: F.exp(x - s["top"])))
    return _shares(weights)


def _shares(weights: Column) -> Column:
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return _once(weights, lambda w: _once(total(w), lambda t: F.transform(w, lambda x: x / t)))


#: Sums of a level's names are broadcast up to so many numbers, 16 MB; beyond, they are joined, names with more pages than HOT split.
BROADCAST_NUMBERS, HOT = 2_000_000, 1_000_000


def _with_sums(pages: DataFrame, seen: DataFrame, level: str, k: int) -> DataFrame:
    """``pages`` with ``{level}_sum``, the sums over all pages of ``seen`` that share the level's name."""
    sums = staged(seen.groupBy(level).agg(_summed("by_text", k).alias(f"{level}_sum"), F.count("*").alias("_pages")), f"{level}-sums")
    if sums.count() * k <= BROADCAST_NUMBERS:
        return pages.join(F.broadcast(sums.drop("_pages")), level)
    salts = F.ceil(F.col("_pages") / HOT).cast("int")
    hot = sums.where(F.col("_pages") > HOT).select(level, salts.alias("_salts"))  # one for each HOT pages at most
    salted = pages.join(hot, level, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("page_id"), F.col("_salts")), F.lit(0).cast("long"))).drop("_salts")
    return salted.join(sums.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - F.lit(1).cast("long")))).drop("_pages"), [level, "_salt"]).drop("_salt")


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _summed(probs: str, k: int) -> Column:
    """The element-wise sum of arrays of k numbers."""
    return F.array(*[F.sum(F.element_at(probs, i + 1)) for i in range(k)])


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each page: ``page_id, lang, probability, text_lang, declared, host, n_grams``.

    ``docs`` (doc_id, text, lang) teaches the languages; ``lang`` is the likeliest of them, of equal
    ones the first by name, and null if ``docs`` names none. A page's own share is taken out of the sums of its
    host, domain and suffix before it is judged by them.

    Null, empty or textless pages are judged by markup and address alone; a null url has the empty host;
    a language declared but never taught is evidence of no language; null ids and repeated rows are judged each; an
    empty table gives an empty one; other columns are not read. Sums are taken before the shuffle and meet the pages as a
    broadcast of checked size or else in a join in which names with very many pages are split. A task holds the text of 200 pages.
    """
    languages, models = fit_models(docs)
    k = len(languages)
    if not k:
        none = F.lit(None).cast("string")
        return page_evidence(pages, models).select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", "host", "n_grams")
    names = F.array(*[F.lit(x) for x in languages])
    seen = staged(page_evidence(pages, models).withColumn("by_text", _normal(F.col("text_logs"))), "page-evidence")
    everywhere = seen.agg(_summed("by_text", k).alias("s")).first().s
    overall = [(x or 0.0) + 1 for x in everywhere]
    overall = [x / sum(overall) for x in overall]
    # how often each language is declared as each name: at most as many names as languages are kept apart
    taught = F.when(F.col("declared").isin(languages), F.col("declared"))
    told = {r.d: r.s for r in seen.where(taught.isNotNull()).groupBy(taught.alias("d")).agg(_summed("by_text", k).alias("s")).collect()}
    table = np.array([told.get(x, [0.0] * k) for x in languages]) + DECLARED / k + np.eye(k) * DECLARED
    told_logs = np.log(table / table.sum(axis=0, keepdims=True))  # [declared, language]
    zeros = F.array(*[F.lit(0.0)] * k)
    declared_logs = F.coalesce(F.element_at(F.create_map(*[x for d in range(k) for x in (F.lit(languages[d]), F.array(*[F.lit(float(v)) for v in told_logs[d]]))]), taught), zeros) if k else zeros
    country = F.create_map(*[F.lit(x) for pair in COUNTRY.items() for x in pair])
    joined = seen
    for level in ("suffix", "domain", "host"):
        joined = _with_sums(joined, seen, level, k)
    prior = F.array(*[F.lit(x) for x in overall])
    lent = F.transform(names, lambda x: F.when(x == F.element_at(country, F.col("suffix")), F.lit(COUNTRY_COUNT)).otherwise(F.lit(0.0)))
    for level in ("suffix", "domain", "host"):
        others = F.zip_with(f"{level}_sum", "by_text", lambda s, own: F.greatest(s - own, F.lit(0.0)))
        if level == "suffix":
            others = _plus(others, lent)
        leaned = F.zip_with(others, prior, lambda n, p: n + p * LEAN)
        joined = joined.withColumn(f"{level}_prior", _shares(leaned))
        prior = F.col(f"{level}_prior")
    logs = _plus(_plus(F.col("text_logs"), declared_logs), F.transform("host_prior", lambda p: F.ln(p)))
    fused = joined.withColumn("fused", _normal(logs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return fused.select("page_id", best(F.col("fused")).alias("lang"), F.array_max("fused").alias("probability"), best(F.col("by_text")).alias("text_lang"), "declared", "host", "n_grams")
