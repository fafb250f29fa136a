"""URL filters by a temporal list join.

Dated entries of a list become validity intervals: an entry holds from its date until the next entry
for the same pattern. An as-of join finds, for each capture, the entry of its host, of each parent
domain and of its path prefixes that was in force when it was fetched; the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read

#: Copies of the intervals, and parts of the captures, under each pattern: a host with a third of all
#: captures is spread over so many tasks.
SALTS = 16
#: Bytes of a list that is broadcast at most, in the estimate of ENTRY bytes and the pattern for each interval.
BROADCAST_BYTES = 16_000_000
ENTRY = 64
ACTIONS = ("allow", "block")


def normalised(url: str = "url") -> tuple[Column, Column]:
    """Columns host (lower case, no port, no leading www.) and path of an absolute http(s) URL; else null."""
    u = F.trim(F.col(url).cast("string"))
    host = F.lower(F.regexp_extract(u, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    path = F.regexp_extract(u, r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    return F.when(host != "", host).alias("host"), F.when(host != "", path).alias("path")


def segments(path) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def patterns(pattern: str = "pattern") -> Column:
    """A pattern in the form of hosts and paths: lower case, no scheme, port, leading www., query or empty segment."""
    p = F.lower(F.trim(F.col(pattern).cast("string")))
    p = F.regexp_replace(p, r"^https?://", "")
    host = F.regexp_extract(p, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    path = segments(F.regexp_extract(p, r"^[^/?#]*([^?#]*)", 1))
    return F.when(host != "", F.concat_ws("/", F.array(host), path)).otherwise("")


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, since, until of entries(pattern, action, listed_at).

    Patterns are host suffixes with an optional path prefix, `example.org` or `example.org/a/b`, of any
    length; they are normalised as URLs are. An entry is in force from listed_at to the next entry of its
    pattern, exclusive. Of entries of one pattern and time, block wins. An action other than allow or block ends what was in force.
    """
    e = entries.select(patterns().alias("pattern"), F.lower(F.trim("action")).alias("action"), F.col("listed_at").cast("timestamp").alias("since"))
    e = e.where("pattern <> '' AND since IS NOT NULL")
    e = e.groupBy("pattern", "since").agg(F.max(F.struct((F.col("action") == "block").alias("b"), "action")).alias("m")).select("pattern", "since", F.col("m.action").alias("action"))
    following = Window.partitionBy("pattern").orderBy("since")
    return e.withColumn("until", F.lead("since").over(following)).where(F.col("action").isin(*ACTIONS)).select("pattern", "action", "since", "until")


def _candidates(host: str, path: str, shapes: list[tuple[int, int]]) -> Column:
    """The patterns that could match, most specific first: longer hosts, then longer paths.

    shapes has the label and segment counts that occur in the list; no other pattern can be met.
    """
    labels, parts = F.split(F.col(host), r"\."), segments(F.col(path))
    made = []
    for n, m in sorted(shapes, reverse=True):
        fits = (F.size(labels) >= n) & (F.size(parts) >= m)
        made.append(F.when(fits, F.lower(F.concat_ws("/", F.array(F.array_join(F.slice(labels, -n, n), ".")), F.slice(parts, 1, m)))))
    return F.filter(F.array(*made).cast("array<string>"), lambda x: x.isNotNull())


def url_verdicts(captures: DataFrame, entries: DataFrame, key: str = "page_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """key, host, verdict, pattern, since for each row of captures(key, url, fetched_at).

    verdict is allow or block after the most specific entry in force at fetched_at, `unlisted` without
    one, and `invalid` for a null or non-http URL or a null time. The patterns of a capture are its rows
    in the join: its host suffixes and path prefixes of the label and segment counts that the list has.
    A list of few enough bytes is broadcast; beyond that both sides are shuffled by pattern and salt. Equal rows of captures get equal verdicts.
    """
    host, path = normalised("url")
    own = captures.select(F.col(key).alias("_key"), host, path, F.col("fetched_at").cast("timestamp").alias("at"))
    listed = durable(intervals(entries))
    shapes = listed.select(F.size(F.split(F.substring_index("pattern", "/", 1), r"\.")).alias("n"), (F.size(F.split("pattern", "/")) - 1).alias("m"), (F.octet_length("pattern") + ENTRY).alias("size"))
    shapes = shapes.groupBy("n", "m").agg(F.sum("size").alias("size")).collect()  # one row for each pair of counts
    size, shapes = sum(r["size"] for r in shapes), [(r.n, r.m) for r in shapes]
    longest = max((m for _, m in shapes), default=0)
    prefix = F.array_join(F.slice(segments(F.col("path")), 1, longest), "/")
    probes = own.where("host IS NOT NULL AND at IS NOT NULL")
    # Captures of one host, path prefix and time get one answer: they are joined once.
    asked = probes.select("host", prefix.alias("path"), "at")
    asked = asked.distinct()
    rows = asked.select("host", "path", "at", F.posexplode(_candidates("host", "path", shapes)).alias("rank", "pattern"))
    if size <= broadcast_bytes:
        met = rows.join(F.broadcast(listed), "pattern")
    else:
        salted = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("host", "path", "at"), F.lit(SALTS)).cast("int"))
        met = rows.hint("merge").join(salted.hint("merge"), ["pattern", "_salt"])
    met = met.where((F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    best = met.groupBy("host", "path", "at").agg(F.min(F.struct("rank", "pattern", "action", "since")).alias("m"))
    own = own.withColumn("_prefix", prefix)
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("at").alias("_a"), "m")
    out = own.join(best, (F.col("host") == F.col("_h")) & (F.col("_prefix") == F.col("_p")) & (F.col("at") == F.col("_a")), "left")
    verdict = F.when(F.col("host").isNull() | F.col("at").isNull(), "invalid").otherwise(F.coalesce("m.action", F.lit("unlisted")))
    return out.select(F.col("_key").alias(key), "host", verdict.alias("verdict"), F.col("m.pattern").alias("pattern"), F.col("m.since").alias("since"))


def dated(pages: DataFrame) -> DataFrame:
    """The test pages have no times; captures are spread over 2024 by page_id."""
    return pages.select("page_id", "url", (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.pmod("page_id", F.lit(366)).cast("int"))).alias("fetched_at"))


def derived_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages: the test tables bring none.

    A third of the hosts is blocked from some day and cleared or allowed 120 days later; three sevenths
    of the parent domains are blocked from the middle of the year; a fifth of the first path segments
    of a host are allowed, and a fifth of its paths of two segments blocked, from some day.
    """
    host, path = normalised("url")
    known = pages.select(host, path).where("host IS NOT NULL")
    hosts = known.select("host").distinct()
    day = lambda salt: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("host"))), 1, 7), 16, 10).cast("long"), F.lit(210)).cast("int")
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    chosen = hosts.where(F.pmod(F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long"), F.lit(3)) == 0)
    first = chosen.select(F.col("host").alias("pattern"), F.lit("block").alias("action"), (start + F.make_dt_interval(day("a"))).alias("listed_at"))
    later = chosen.select(F.col("host").alias("pattern"), F.when(F.pmod(day("b"), F.lit(2)) == 0, "allow").otherwise("clear").alias("action"), (start + F.make_dt_interval(day("a") + 120)).alias("listed_at"))
    parents = hosts.select(F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".").alias("host")).distinct().where(F.pmod(F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long"), F.lit(7)) < 3)
    wide = parents.select(F.col("host").alias("pattern"), F.lit("block").alias("action"), (start + F.make_dt_interval(F.lit(182))).alias("listed_at"))
    folders = known.select("host", segments(F.lower("path")).alias("s")).select("host", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("allow").alias("action")), F.struct(F.lit(2).alias("n"), F.lit("block").alias("action")))).alias("x"), "s").where("size(s) >= x.n")
    folders = folders.select(F.concat_ws("/", F.array("host"), F.slice("s", 1, F.col("x.n"))).alias("host"), "x.action").distinct().where(F.pmod(F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long"), F.lit(5)) == 0)
    deep = folders.select(F.col("host").alias("pattern"), "action", (start + F.make_dt_interval(day("c"))).alias("listed_at"))
    return first.unionByName(later).unionByName(wide).unionByName(deep)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    out = url_verdicts(dated(pages), durable(derived_list(pages)))
    return out.select("page_id", "host", "verdict", "pattern", F.date_format("since", "yyyy-MM-dd").alias("since"))


OP7_SQL = r"""
WITH p AS (SELECT page_id, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) AS seen,
                  nullif(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '^www\.', ''), '') AS host,
                  regexp_extract(trim(url), '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
c AS (SELECT host, CAST(('0x' || substr(md5('a' || host), 1, 7)) AS BIGINT) % 210 AS a, CAST(('0x' || substr(md5('b' || host), 1, 7)) AS BIGINT) % 210 AS b
      FROM h WHERE CAST(('0x' || substr(md5(host), 1, 7)) AS BIGINT) % 3 = 0),
f AS (SELECT DISTINCT host || '/' || array_to_string(s[1:n], '/') AS folder, action FROM (SELECT host, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS s FROM p WHERE host IS NOT NULL), (VALUES (1, 'allow'), (2, 'block')) t(n, action) WHERE len(s) >= n),
par AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS host FROM h),
e AS (SELECT host AS pattern, 'block' AS action, TIMESTAMP '2024-01-01' + to_days(CAST(a AS INTEGER)) AS since FROM c
      UNION ALL SELECT host, CASE WHEN b % 2 = 0 THEN 'allow' ELSE 'clear' END, TIMESTAMP '2024-01-01' + to_days(CAST(a + 120 AS INTEGER)) FROM c
      UNION ALL SELECT host, 'block', TIMESTAMP '2024-01-01' + to_days(182) FROM par WHERE CAST(('0x' || substr(md5(host), 1, 7)) AS BIGINT) % 7 < 3
      UNION ALL SELECT folder, action, TIMESTAMP '2024-01-01' + to_days(CAST(CAST(('0x' || substr(md5('c' || folder), 1, 7)) AS BIGINT) % 210 AS INTEGER)) FROM f WHERE CAST(('0x' || substr(md5(folder), 1, 7)) AS BIGINT) % 5 = 0),
i AS (SELECT pattern, action, since, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM e),
q AS (SELECT page_id, seen, host, lower(host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') || '/') AS whole FROM p WHERE host IS NOT NULL),
c2 AS (SELECT page_id, seen, pattern, action, since, until FROM q JOIN i ON host = split_part(pattern, '/', 1) AND starts_with(whole, pattern || '/')
       UNION ALL SELECT page_id, seen, pattern, action, since, until FROM q JOIN i ON ends_with(host, '.' || split_part(pattern, '/', 1)) AND starts_with(substr(whole, length(host) - length(split_part(pattern, '/', 1)) + 1), pattern || '/')),
m AS (SELECT page_id, pattern, action, since, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(split_part(pattern, '/', 1), '.')) DESC, len(string_split(pattern, '/')) DESC) AS k
      FROM c2 WHERE seen >= since AND (until IS NULL OR seen < until) AND action IN ('allow', 'block'))
SELECT p.page_id, host, CASE WHEN host IS NULL THEN 'invalid' ELSE coalesce(action, 'unlisted') END AS verdict, pattern, strftime(since, '%Y-%m-%d') AS since
FROM p LEFT JOIN m ON p.page_id = m.page_id AND k = 1
"""
