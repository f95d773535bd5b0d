"""URL filter: host and path rules, then a character language-model ratio.

URLs that a rule judges teach two smoothed variable-order Markov models, one of
allowed and one of blocked URLs: the probability of a symbol given the two before
it, each order interpolated with the next shorter one by Witten-Bell. Every
other URL is judged by the mean over its symbols of the log-likelihood
difference, against a threshold that is calibrated on a fold of the judged URLs
left out of training: the point as many standard deviations from the mean of
either class. Only DataFrame functions run.

The symbols are 26 letters, one for digits, 32 marks, one for all else, one
before and one behind a URL, so the table of trigrams has at most
``SYMBOLS ** ORDER`` rows (some 10 MB) at every size, and is broadcast.

Defined results: a null URL or one without ``://`` has empty host and path, no
rule, and is judged by its text like any other (null as the empty text); without
URLs of both classes the threshold is 0 and a tie allows; equal URLs get equal
verdicts; repeated rows stay; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

SYMBOLS = 26 + 1 + 32 + 1 + 2
ORDER = 3
_START, _END = "\u0001", "\u0002"
#: Two hex digits of a URL's MD5 under this are the calibration fold (a fifth).
HELD_OUT = "33"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], pick: str) -> Column:
    """The longest fitting rule's text or verdict, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, r.host + r.path if pick == "rule" else r.verdict).otherwise(out)
    return out


def symbols_of(url: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.lower(url), "123456789", "000000000"), r"[^\x21-\x7e]", " ")
    return F.concat(F.lit(_START * (ORDER - 1)), plain, F.lit(_END))


def grams_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{ORDER}}}))"), F.lit(1))


def gram_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio): log p(last symbol | those before) of the allowed model less
    the blocked model's, for every gram of ``grams`` (gram, allow, block), which
    has each class's counts, zero for grams of other URLs only."""
    rows = grams
    probability = {c: F.lit(1.0 / SYMBOLS) for c in ("allow", "block")}
    for n in range(1, ORDER + 1):
        tail = F.substring("gram", ORDER - n + 1, n)
        context = F.substring("gram", ORDER - n + 1, n - 1) if n > 1 else F.lit("")
        rows = rows.withColumns({f"tail{n}": tail, f"context{n}": context})
        seen, given = Window.partitionBy(f"tail{n}"), Window.partitionBy(f"context{n}")
        for c in ("allow", "block"):
            rows = rows.withColumn(f"{c}_c{n}", F.sum(c).over(seen))
        first = F.row_number().over(Window.partitionBy(f"tail{n}").orderBy("gram")) == 1
        rows = rows.withColumn(f"first{n}", first)
        for c in ("allow", "block"):
            rows = rows.withColumns({f"{c}_n{n}": F.sum(c).over(given), f"{c}_t{n}": F.sum(F.when(F.col(f"first{n}") & (F.col(f"{c}_c{n}") > 0), 1).otherwise(0)).over(given)})
            count, total, types = (F.col(f"{c}_{x}{n}") for x in "cnt")
            probability[c] = F.when(total > 0, (count + types * probability[c]) / (total + types)).otherwise(probability[c])
        rows = rows.withColumns({f"{c}_p{n}": probability[c] for c in probability})
        probability = {c: F.col(f"{c}_p{n}") for c in probability}
    return rows.select("gram", (F.log(probability["allow"]) - F.log(probability["block"])).alias("ratio"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row; score is the mean
    log-likelihood difference less the threshold, to nine decimals."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumns({p: rule_of(F.col("host"), F.col("path"), rules, p) for p in ("rule", "ruled")})
    rows = rows.withColumn("held", F.substring(F.md5("url"), 1, 2) < HELD_OUT)

    shown = rows.select("ruled", "held", F.explode(grams_of(symbols_of(F.col("url")))).alias("gram"))
    taught = lambda c: F.count_if((F.col("ruled") == c) & ~F.col("held")).alias(c)
    ratios = gram_ratios(shown.groupBy("gram").agg(taught("allow"), taught("block"))).persist()

    parts = rows.select(F.monotonically_increasing_id().alias("row"), "*").select("*", F.explode(grams_of(symbols_of(F.col("url")))).alias("gram"))
    scored = parts.join(F.broadcast(ratios), "gram").groupBy("row", "id", "host", "path", "rule", "ruled", "held").agg(F.round(F.avg("ratio"), 9).alias("mean"))
    fold = scored.where("held and ruled is not null").groupBy("ruled").agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s")).collect()
    by = {r["ruled"]: r for r in fold}
    threshold = 0.0
    if "allow" in by and "block" in by:
        a, b = by["allow"], by["block"]
        threshold = round((a["m"] * b["s"] + b["m"] * a["s"]) / (a["s"] + b["s"]) if a["s"] + b["s"] else (a["m"] + b["m"]) / 2, 9)
    score = F.round(F.col("mean") - threshold, 9)
    verdict = F.coalesce("ruled", F.when(score >= 0, "allow").otherwise("block"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL, over ``pages``."""
    longest = sorted(rules, key=lambda r: -len(r.host) - len(r.path))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{pick(r)}'" for r in longest) + " END"
    steps, before = [], {c: f"{1.0 / SYMBOLS!r}" for c in ("allow", "block")}
    for n in range(1, ORDER + 1):
        source = "grams" if n == 1 else f"p{n - 1}"
        steps.append(f"""k{n} AS (SELECT *, right(gram, {n}) AS tail{n}, left(right(gram, {n}), {n - 1}) AS context{n} FROM {source}),
s{n} AS (SELECT *, {", ".join(f"sum({c}) OVER (PARTITION BY tail{n}) AS {c}_c{n}" for c in before)}, row_number() OVER (PARTITION BY tail{n} ORDER BY gram) = 1 AS first{n} FROM k{n}),
t{n} AS (SELECT *, {", ".join(f"sum({c}) OVER (PARTITION BY context{n}) AS {c}_n{n}, sum(CASE WHEN first{n} AND {c}_c{n} > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY context{n}) AS {c}_t{n}" for c in before)} FROM s{n}),
p{n} AS (SELECT *, {", ".join(f"CASE WHEN {c}_n{n} > 0 THEN ({c}_c{n} + {c}_t{n} * {p}) / ({c}_n{n} + {c}_t{n}) ELSE {p} END::DOUBLE AS {c}_p{n}" for c, p in before.items())} FROM t{n})""")
        before = {c: f"{c}_p{n}" for c in before}
    return f"""WITH u AS (SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r AS (SELECT *, {case(lambda r: r.host + r.path)} AS rule, {case(lambda r: r.verdict)} AS ruled, left(md5(url), 2) < '{HELD_OUT}' AS held,
  repeat(chr(1), {ORDER - 1}) || regexp_replace(translate(lower(url), '123456789', '000000000'), '[^\\x21-\\x7e]', ' ', 'g') || chr(2) AS text FROM h),
g AS (SELECT row, ruled, held, substr(text, i, {ORDER}) AS gram FROM (SELECT *, unnest(generate_series(1, length(text) - {ORDER - 1})) AS i FROM r)),
grams AS (SELECT gram, count(*) FILTER (ruled = 'allow' AND NOT held) AS allow, count(*) FILTER (ruled = 'block' AND NOT held) AS block FROM g GROUP BY gram),
{",".join(steps)},
ratios AS (SELECT gram, ln({before["allow"]}) - ln({before["block"]}) AS ratio FROM p{ORDER}),
scored AS (SELECT row, round(avg(ratio), 9) AS mean FROM g JOIN ratios USING (gram) GROUP BY row),
fold AS (SELECT ruled, avg(mean) AS m, stddev_pop(mean) AS s FROM scored JOIN r USING (row) WHERE held AND ruled IS NOT NULL GROUP BY ruled),
level AS (SELECT coalesce(round(CASE WHEN a.s + b.s > 0 THEN (a.m * b.s + b.m * a.s) / (a.s + b.s) ELSE (a.m + b.m) / 2 END, 9), 0) AS threshold
  FROM (SELECT 1) LEFT JOIN (SELECT * FROM fold WHERE ruled = 'allow') a ON true LEFT JOIN (SELECT * FROM fold WHERE ruled = 'block') b ON true)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN round(mean - threshold, 9) >= 0 THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN scored USING (row), level"""
