"""URL filters: a fixed list of host and path rules, then association rules mined from labels.

Mining: a labelled page is a basket of URL tokens (host parts, path parts, parameter names). Tokens
that stand on the same labelled pages are one class, known by its least token: they change no count,
and sets of them would only multiply. A class with `least_pages` bad pages, of which at least
`confidence` of its pages are bad, is a rule alone. The others go to FP-growth over the bad pages: a
set of classes on `least_pages` of them is a candidate, its confidence follows from the good pages
that hold it (met through an inverted index), and a rule is a candidate that holds no smaller rule.
Sets have any length and tokens any frequency; only classes on all labelled pages are left out, as
they change no confidence. Larger rules than the minimal ones would match no further page. The least
number of pages is absolute, so what is caught on a small table is caught in a larger one.
FP-growth's item table is at most (tokens on bad labelled pages) / `least_pages` names; its sets
grow with the combinations of classes that differ in their pages.

Matching: every rule stands in an inverted index under its rarest class. Pages meet the index by
the classes of their tokens (any token of a class stands for it), whole rules are then tested inside
the row, and the best match of a URL goes back to its pages. Spark broadcasts the index or the
matches if they are small; it may shuffle and split them otherwise. All is DataFrame work and Spark
ML; the host of a third of all pages is a value in no join key but its own URL's.

Defined results: a null URL or one without :// has empty host and path, no tokens, no rule and is
allowed; pages with one URL are judged alike; a page id with several labels counts as bad if one is
(quality 0 or toxic 1), null labels are none; other columns don't matter; without labels or pages
there are no mined rules; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.llm.common import settle, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host, path, verdict; the longest fitting rule wins
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MINING = {"least_pages": 5, "confidence": 0.6}


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct parts of host and path and names of parameters; runs of digits are alike."""
    def parts(text: Column, cut: str, mark: str) -> Column:
        named = F.transform(F.split(F.translate(text, UPPER, LOWER), cut), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")))
        return F.filter(named, lambda x: F.length(x) > len(mark))

    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.regexp_replace(query, "=[^&]*", "")
    found = F.array_distinct(F.concat(parts(host(url), "[.:@]", "h:"), parts(path(url), r"[/._\-]", "p:"), parts(names, "&", "q:")))
    return F.coalesce(found, F.array().cast("array<string>"))


def listed(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest fitting rule of a short list; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later ones are outermost
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


@dataclass
class Rules:
    """classes: item, term (the class). rules: terms (sorted classes), term (the rarest, for the index), confidence, pages."""

    classes: DataFrame
    rules: DataFrame


def _holding(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (with classes `held`) and sets (terms, term) that they hold, met by the sets' rarest class."""
    return rows.withColumn("term", F.explode("held")).join(sets, "term").where(F.size(F.array_except("terms", "held")) == 0)


def mine(pages: DataFrame, labels: DataFrame, least_pages: int, confidence: float) -> Rules:
    """Minimal rules of at least `least_pages` bad pages and `confidence`."""
    bad = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).where("bad is not null")
    seen = pages.select(F.col("page_id").alias("id"), tokens(F.col("url")).alias("items")).join(bad, "id")
    seen = settle(seen.select(F.monotonically_increasing_id().alias("row"), "items", "bad"))
    n = seen.count()
    each = seen.select("row", "bad", F.explode("items").alias("item"))
    # the pages of a token are known by their number and 128 bits
    cover = each.groupBy("item").agg(F.count("*").alias("pages"), F.sum("bad").alias("both"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit("y"))).alias("y"))
    cover = cover.where((F.col("both") >= least_pages) & (F.col("pages") < n))
    cover = settle(cover.withColumn("term", F.min("item").over(Window.partitionBy("pages", "both", "x", "y"))))
    single = cover.where("item = term").select("term", "pages", (F.col("both") / F.col("pages")).alias("confidence"))
    alone = single.where(F.col("confidence") >= confidence)
    rules = alone.select(F.array("term").alias("terms"), "term", "confidence", "pages")

    # sets of the other classes; a page holds a class once
    rest = settle(single.where(F.col("confidence") < confidence).select("term", F.col("pages").alias("term_pages")))
    open_classes = cover.select("item", "term").join(rest.select("term"), "term")
    held = settle(each.join(open_classes, "item").groupBy("row", "bad").agg(F.array_sort(F.collect_set("term")).alias("held")))
    baskets = held.where("bad = 1").select("held")
    n_bad = baskets.count()
    if n_bad >= least_pages:
        found = FPGrowth(itemsCol="held", minSupport=(least_pages - 0.5) / n_bad).fit(baskets).freqItemsets
        found = settle(found.where(F.size("items") > 1).select(F.array_sort("items").alias("terms"), F.col("freq").alias("both")))
        rarest = found.select("terms", F.explode("terms").alias("term")).join(rest, "term").groupBy("terms").agg(F.min(F.struct("term_pages", "term"))["term"].alias("term"))
        sets = settle(found.join(rarest, "terms"))
        good = _holding(held.where("bad = 0").select("held"), sets.select("terms", "term")).groupBy("terms").agg(F.count("*").alias("good"))
        sets = sets.join(good, "terms", "left").withColumn("pages", F.col("both") + F.coalesce("good", F.lit(0)))
        sets = settle(sets.withColumn("confidence", F.col("both") / F.col("pages")).where(F.col("confidence") >= confidence).select("terms", "term", "confidence", "pages"))
        smaller = sets.select(F.col("terms").alias("part"), "term")
        within = sets.select(F.col("terms").alias("whole"), F.explode("terms").alias("term")).join(smaller, "term")
        within = within.where((F.size("part") < F.size("whole")) & (F.size(F.array_except("part", "whole")) == 0)).select(F.col("whole").alias("terms")).distinct()
        rules = rules.unionByName(sets.join(within, "terms", "left_anti").select("terms", "term", "confidence", "pages"))
    rules = settle(rules)
    used = rules.select(F.explode("terms").alias("term")).distinct()
    return Rules(settle(cover.select("item", "term").join(used, "term")), rules)


def judge(pages: DataFrame, mined: Rules, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every page with host, path, rule, verdict, and the best mined rule that fits its URL."""
    urls = pages.where("url is not null").select("url").distinct()
    held = urls.select("url", F.explode(tokens(F.col("url"))).alias("item")).join(mined.classes, "item").groupBy("url").agg(F.collect_set("term").alias("held"))
    hits = _holding(held, mined.rules)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", F.size("terms").alias("n"), F.concat_ws(" ", "terms").alias("terms"))).alias("best"))
    out = pages.select("page_id", "url").join(best, "url", "left")
    out = out.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "best")
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    mined_verdict = F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined_verdict).alias("verdict"), F.col("best.terms").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, mine(pages, table(spark, sf_dir, "labels"), **MINING))


def _sql() -> str:
    def parts(text: str, cut: str, mark: str) -> str:
        return (f"list_filter(list_transform(regexp_split_to_array(translate({text}, '{UPPER}', '{LOWER}'), '{cut}'),"
                f" lambda x: '{mark}' || regexp_replace(x, '[0-9]+', '0', 'g')), lambda x: length(x) > {len(mark)})")

    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    best = "NULL"
    verdict = "NULL"
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        best, verdict = f"CASE WHEN {fits} THEN '{h + p}' ELSE {best} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    m = MINING
    return f"""
WITH RECURSIVE u AS MATERIALIZED (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '=[^&]*', '', 'g') AS names
  FROM (SELECT page_id, url, coalesce({rest}, '') AS rest FROM pages)),
t AS MATERIALIZED (SELECT page_id, url, host, path, list_distinct(list_concat({parts('host', '[.:@]', 'h:')}, {parts('path', '[/._\\-]', 'p:')}, {parts('names', '&', 'q:')})) AS items FROM u),
b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels GROUP BY 1),
s AS MATERIALIZED (SELECT row_number() OVER () AS r, items, bad FROM t JOIN b ON b.doc_id = t.page_id WHERE bad IS NOT NULL),
e AS MATERIALIZED (SELECT r, bad, unnest(items) AS item FROM s),
o AS MATERIALIZED (SELECT item, min(item) OVER (PARTITION BY cover) AS term, conf FROM (
  SELECT item, list(r ORDER BY r) AS cover, sum(bad)::DOUBLE / count(*) AS conf FROM e GROUP BY item HAVING sum(bad) >= {m['least_pages']} AND count(*) < (SELECT count(*) FROM s))),
f AS MATERIALIZED (SELECT DISTINCT r, bad, term FROM e JOIN o USING (item) WHERE conf < {m['confidence']}::DOUBLE),
c AS (SELECT r, bad, [term] AS terms FROM f UNION ALL SELECT c.r, c.bad, list_append(terms, term) FROM c JOIN f ON f.r = c.r AND f.term > c.terms[-1]),
k AS MATERIALIZED (SELECT terms, sum(bad)::DOUBLE / count(*) AS confidence FROM c WHERE len(terms) > 1 GROUP BY terms
  HAVING sum(bad) >= {m['least_pages']} AND sum(bad)::DOUBLE / count(*) >= {m['confidence']}::DOUBLE),
v AS MATERIALIZED (SELECT DISTINCT [term] AS terms, conf AS confidence FROM o WHERE conf >= {m['confidence']}::DOUBLE
  UNION ALL SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k p WHERE len(p.terms) < len(k.terms) AND list_has_all(k.terms, p.terms))),
d AS (SELECT url, list(DISTINCT term) AS held FROM (SELECT DISTINCT url, unnest(items) AS item FROM t) JOIN o USING (item) GROUP BY url),
h AS (SELECT url, max({{'confidence': confidence, 'n': len(terms), 'terms': array_to_string(terms, ' ')}}) AS best FROM d JOIN v ON list_has_all(d.held, v.terms) GROUP BY url)
SELECT page_id, host, path, {best} AS rule, coalesce({verdict}, CASE WHEN best IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  best.terms AS mined_rule, best.confidence AS mined_confidence FROM t LEFT JOIN h USING (url)"""


ORACLE_SQL = {"op1_url_filters": _sql()}
QUERIES = {"op1_url_filters": op1_url_filters}
