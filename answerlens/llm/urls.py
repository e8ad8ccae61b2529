"""URL filters: allow and block rules, and logistic regression on hashed character n-grams for what no rule fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerlens.llm.words import mix, U

#: (verdict, host, path) of the production rules.
RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]
#: Lengths of the n-grams, and bits of the cells they are hashed to (512 KB of weights).
NGRAMS, BITS = (3, 4, 5), 16
#: Labelled URLs that are learned from, at most; URLs of more characters are not learned from.
MAX_LABELLED, MAX_LEARNED_CHARS = 20_000, 2_000
ROUNDS, SHRINK = 400, 2e-4
#: Bytes of URLs that are cut into n-grams together.
SLICE = 1 << 18

#: Words of hosts and paths that crawls leave out, by topic, and of ordinary ones.  The labelled table is made of them.
UNWANTED = """
    casino poker roulette jackpot slots betting bets bet gamble lottery bingo win free-spins bonus
    pills viagra cialis pharmacy meds steroids diet-pills cheap-meds tablets
    adult porn xxx sex sexcam escort nude erotic dating-hot
    ads adserver ad-track tracker tracking clickbait popunder banner-ads doubleclick affiliate
    spam spamlink link-farm seo-links doorway warez keygen crack torrent phishing malware
    payday-loan fast-cash replica cheap-watches get-rich free-money earn-money win-prize
""".split()
ORDINARY = """
    news weather library school university history science museum garden kitchen recipes travel journal letters
    hospital doctor research city council market railway station football tennis music opera theatre cinema
    books writer poems language grammar dictionary translate physics chemistry biology maths geology astronomy
    river mountain forest island harbour village church castle bridge street tower farmhouse animals birds
    horses cooking bread cheese coffee tea wine photo camera painting sculpture design craft wood metal
    software python linux server database network project manual guide tutorial lesson course student teacher
    parents children family health sports running cycling sailing fishing hiking camping train flight hotel
    blog forum wiki archive docs help about contact shop store mail status press jobs events calendar
    the that there this then than other another mother father weather gather tion nation station action
""".split()
_TOP = ["com", "org", "net", "info", "example.com", "example.org", "example.net", "de", "fr", "es", "co.uk"]
_FRONT = ["", "www.", "blog.", "m.", "shop.", ""]
_ENDS = ["", "/", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "/{w}/{n}", "/{w}.html", "/{w}/{v}"]


def labelled_urls() -> list[tuple[str, bool]]:
    """(url, unwanted): the small labelled table, made of the words above by a fixed rule."""
    out = []
    for words, unwanted in ((UNWANTED, True), (ORDINARY, False)):
        every = len(words)
        for k, word in enumerate(words):
            for turn in range(14 if unwanted else 7):
                at = k * 31 + turn * 17
                other = words[(at + 7) % every]
                name = (word, f"{word}-{other}", f"{word}{other}", f"{other}-{word}", f"my{word}", f"{word}{at % 90}")[turn % 6]
                end = _ENDS[at % len(_ENDS)].format(n=at * 7919 % 99_991, w=word, v=other)
                if turn % 7 == 6 and not unwanted:  # words of the path alone, under a host that says nothing
                    name, end = f"site{at % 50}", f"/{word}/{other}"
                out.append((f"https://{_FRONT[at % len(_FRONT)]}{name}.{_TOP[at % len(_TOP)]}{end}", unwanted))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a text without ``://``."""
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (n, rule, verdict) that fits, or null; of equally long ones the last by code points."""
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    return F.greatest(none, none, *fits)


def ngrams(urls: list[tuple[str, str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """URL number, cell and weight of the n-grams of (host, path) pairs, a bounded number at a time.

    Hosts and paths have cells of their own; each field is marked at both ends and its weights are 1 / sqrt(its n-grams).
    """
    fields = [b"\x02" + x.encode("utf-8", "replace") + b"\x03" for pair in urls for x in pair]
    data = np.frombuffer(b"".join(fields), np.uint8)
    size = np.fromiter(map(len, fields), np.int64, len(fields))
    stop = np.cumsum(size)
    number = sum(np.maximum(size - n + 1, 0) for n in NGRAMS)
    weight = 1 / np.sqrt(np.maximum(number, 1))
    for lo in range(0, len(data), SLICE):
        at = np.arange(lo, min(lo + SLICE, len(data)))
        field = np.searchsorted(stop, at, "right")
        left = stop[field] - at
        for n in NGRAMS:
            good = left >= n
            begin, own = at[good], field[good]
            code = (own.astype(U) & U(1)) << U(48) | U(n) << U(56)
            for k in range(n):
                code |= data[begin + k].astype(U) << U(8 * k)
            yield own >> 1, (mix(code) >> U(64 - BITS)).astype(np.int64), weight[own]


class UrlModel:
    """Weights of the cells and an intercept; a positive score is an unwanted URL."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def scores(self, urls: list[tuple[str, str]]) -> np.ndarray:
        out = np.full(len(urls), self.intercept)
        for row, cell, weight in ngrams(urls):
            out += np.bincount(row, self.weights[cell] * weight, len(urls))
        return out


def fit(urls: list[tuple[str, str]], unwanted: np.ndarray, rounds: int = ROUNDS, shrink: float = SHRINK) -> UrlModel:
    """Logistic regression with both classes of equal weight, by accelerated gradient steps.

    With one class only, or none, the intercept alone speaks for it (allow, if there is nothing to learn from).
    """
    yes, no = int(unwanted.sum()), int((~unwanted).sum())
    w, b = np.zeros(1 << BITS), 0.0
    if not yes or not no:
        return UrlModel(w, float(yes > 0) - float(no > 0))
    row, cell, value = (np.concatenate(x) for x in zip(*ngrams(urls)))
    share = np.where(unwanted, 0.5 / yes, 0.5 / no)
    step = 1 / (0.25 * 3 + shrink)  # a URL's features have norm sqrt(2) at most, with the intercept sqrt(3)
    before, before_b = w, b
    for k in range(rounds):
        ahead = k / (k + 3)
        v, c = w + ahead * (w - before), b + ahead * (b - before_b)
        score = np.bincount(row, v[cell] * value, len(urls)) + c
        error = share * (1 / (1 + np.exp(-score)) - unwanted)
        before, before_b = w, b
        w = v - step * (np.bincount(cell, value * error[row], len(w)) + shrink * v)
        b = c - step * error.sum()
    return UrlModel(w, float(b))


def learn(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> UrlModel:
    """Fit to a table (url, unwanted boolean): at most ``max_labelled`` different rows, drawn by hash.

    URLs of more than MAX_LEARNED_CHARS characters and null labels are left out, so what reaches the driver is bounded.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter((F.char_length("url") <= MAX_LEARNED_CHARS) & F.col("unwanted").isNotNull()).select(
        host.alias("host"), path.alias("path"), "unwanted"
    ).distinct()
    drawn = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "unwanted").limit(max_labelled).collect()
    return fit([(r[0], r[1]) for r in drawn], np.array([r[2] for r in drawn], bool))


def default_model(spark: SparkSession) -> UrlModel:
    return learn(spark.createDataFrame(labelled_urls(), "url string, unwanted boolean"))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.add(pc.binary_length(batch.column("host")), pc.binary_length(batch.column("path"))).to_numpy()
            total = np.cumsum(size)
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE, "right")))
                part = batch.slice(lo, hi - lo)
                urls = list(zip(part.column("host").to_pylist(), part.column("path").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.value.scores(urls))], [*part.schema.names, "score"]
                )
                lo = hi

    return run


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None, id_column: str = "page_id",
) -> DataFrame:
    """Per page its host, path, the rule that decides (else null), the verdict and the score.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with the rule's; the longest wins.
    Where none fits, the verdict is ``block`` for a positive score of the model (fitted to ``labelled_urls`` unless
    given).  Rules are a list of the configuration and become one column expression; the pages are scanned once and never
    shuffled, and of their columns only the URL is read.

    Null URLs and those without ``://`` have an empty host and path, fit no rule and are allowed by the default model.
    Repeated rows are judged each for itself, null ids pass through, an empty table gives no rows, further columns
    are ignored.  URLs are taken whole, whatever their length.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model or default_model(spark))  # 512 KB
    host, path = host_and_path(F.col("url"))
    kind = pages.schema[id_column].dataType.simpleString()
    cut = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    ruled = cut.withColumn("decided", rule_of(F.col("host"), F.col("path"), rules)).select(
        "id", "host", "path", "decided.rule", F.col("decided.verdict").alias("ruled")
    )
    scored = ruled.mapInArrow(_scored(shared), f"id {kind}, host string, path string, rule string, ruled string, score double")
    learned = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score"
    )
