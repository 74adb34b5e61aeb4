"""The engine's queries over the supplied tables, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnstore.functions import scalars as S
from cairnstore.operators import bytewise as B
from cairnstore.operators import catalog as C

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return C.document_entries(table(spark, sf_dir, "documents"))


def _pages(spark, sf_dir):
    return C.page_entries(table(spark, sf_dir, "pages"))


def _literal(spark, column, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"ord int, {column} string")


def _sql_values(column, values):
    rows = ", ".join("({}, '{}')".format(i, v.replace("'", "''")) for i, v in enumerate(values))
    return f"(SELECT * FROM (VALUES {rows}) t(ord, {column}))"


DOCS = """(SELECT doc_id AS entry_id, concat(source, '/', lang, '/', doc_id, '.txt') AS name, 'file' AS kind,
  CAST(strlen(text) AS BIGINT) AS size, text FROM documents)"""
PAGES = """(SELECT page_id AS entry_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?].*$', '') AS name,
  CAST(strlen(html) AS BIGINT) AS size, html FROM pages)"""
HASH = "substr(sha256(text), 1, 32)"


@query(f"""
WITH u AS (SELECT split_part(name, '/', 1) AS grp, {HASH} AS h, count(*) AS n, sum(size) AS bytes, max(size) AS one FROM {DOCS} GROUP BY 1, 2)
SELECT grp, CAST(sum(n) AS BIGINT) AS n_files, count(*) AS n_unique, CAST(sum(bytes) AS BIGINT) AS raw_bytes,
  CAST(sum(one) AS BIGINT) AS unique_bytes, round(100.0 * CAST(sum(one) AS DOUBLE) / sum(bytes), 2) AS ratio FROM u GROUP BY grp""")
def dedup_report(spark, sf_dir):
    return C.dedup_report(_docs(spark, sf_dir), F.split_part(F.col("name"), F.lit("/"), F.lit(1)))


@query(f"SELECT {HASH} AS hash, min(entry_id) AS entry_id, arg_min(name, entry_id) AS name, count(*) AS n_refs FROM {DOCS} GROUP BY 1")
def dedup_first_wins(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("hash", S.content_hash(F.col("content")))
    return C.first_wins(rows, "hash", ["entry_id"], ["entry_id", "name"])


@query(f"""SELECT hash, entry_id, n, first FROM (SELECT {HASH} AS hash, entry_id, count(*) OVER (PARTITION BY {HASH}) AS n,
  min(entry_id) OVER (PARTITION BY {HASH}) AS first FROM {DOCS}) WHERE n > 1""")
def duplicate_groups(spark, sf_dir):
    """Every member of a group of copies with the group's size and first member; no group is gathered."""
    rows = _docs(spark, sf_dir).select(S.content_hash(F.col("content")).alias("hash"), "entry_id")
    return C.with_groups(rows, "hash", "entry_id").where("n > 1")


HUMAN = """CASE WHEN size < 1024 THEN concat(size, ' B') WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0)
  ELSE printf('%.1f MB', size / 1048576.0) END"""


@query(f"SELECT name, size, kind FROM {DOCS}")
def list_entries(spark, sf_dir):
    return _docs(spark, sf_dir).select("name", "size", "kind").orderBy("name")


@query(f"""SELECT name, size, {HUMAN} AS human, CASE WHEN entry_id % 3 = 0 THEN '-rwxr-xr-x' WHEN entry_id % 3 = 1 THEN '-rw-r--r--' ELSE '-r--------' END AS mode_string FROM {DOCS}""")
def list_long(spark, sf_dir):
    mode = F.when(F.col("entry_id") % 3 == 0, 0o755).when(F.col("entry_id") % 3 == 1, 0o644).otherwise(0o400)
    return C.list_long(_docs(spark, sf_dir).withColumn("mode", mode))


@query(f"""SELECT count(*) AS n_files, CAST(0 AS BIGINT) AS n_dirs, CAST(0 AS BIGINT) AS n_links, CAST(sum(size) AS BIGINT) AS total_size
FROM (SELECT size FROM {DOCS} UNION ALL SELECT size FROM {PAGES})""")
def listing_totals(spark, sf_dir):
    return C.listing_totals(_docs(spark, sf_dir).unionByName(_pages(spark, sf_dir)))


@query(f"""SELECT count(*) FILTER (size > 4096) AS n_stored, count(*) FILTER (size <= 4096) AS n_compressed,
  CAST(sum(size) FILTER (size > 4096) AS BIGINT) AS stored_bytes, CAST(sum(size) FILTER (size <= 4096) AS BIGINT) AS compressed_bytes,
  round(100.0 * CAST(sum(size) FILTER (size > 4096) AS DOUBLE) / sum(size), 2) AS stored_share FROM {DOCS}""")
def archive_profile(spark, sf_dir):
    return C.archive_profile(_docs(spark, sf_dir).select(F.col("size").alias("n_bytes"), (F.col("size") > 4096).alias("stored")))


GLOBS = ["src1*", "*7.txt", "fr"]


@query(f"""SELECT name FROM {DOCS} WHERE NOT (
  len(list_filter(string_split(name, '/'), lambda s: regexp_full_match(s, 'src1[^/]*') OR regexp_full_match(s, '[^/]*7[.]txt') OR s = 'fr')) > 0)""")
def exclude_glob(spark, sf_dir):
    return _docs(spark, sf_dir).where(~S.excluded(F.col("name"), GLOBS)).select("name")


@query(f"""SELECT name, CASE WHEN starts_with(name, 'src1/') THEN substr(name, 6) ELSE regexp_extract(name, '([^/]*)$', 1) END AS stored FROM {DOCS}""")
def stored_name(spark, sf_dir):
    return _docs(spark, sf_dir).select("name", S.stored_name(F.col("name"), "src1").alias("stored"))


PARENTS = f"""SELECT string_split(concat('/data/', name), '/')[:-2] AS p FROM {DOCS} WHERE starts_with(name, (SELECT min(split_part(name, '/', 1)) FROM {DOCS}))"""


@query(f"""SELECT array_to_string(a[1:coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] IS DISTINCT FROM b[i])), len(a) + 1) - 1], '/') AS root
FROM (SELECT min(p) AS a, max(p) AS b FROM ({PARENTS}))""")
def common_root(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    first = docs.agg(F.min(F.split_part(F.col("name"), F.lit("/"), F.lit(1)))).first()[0]
    return C.common_root(docs.where(F.col("name").startswith(first or "")).select(F.concat(F.lit("/data/./"), "name").alias("path")), "path")


NAMES = ["a/b", "", "/abs", "../x", "a/../b", "a..b", "a\\..\\b", "..", "x/..", "...", "dir/file"]


@query(f"""SELECT n, n <> '' AND NOT starts_with(n, '/') AND NOT list_contains(string_split_regex(n, '[/\\\\]'), '..') AS safe
FROM (SELECT name AS n FROM {PAGES} UNION ALL SELECT name FROM {_sql_values("name", NAMES)})""")
def safe_name_check(spark, sf_dir):
    names = _pages(spark, sf_dir).select("name").unionByName(_literal(spark, "name", NAMES).select("name"))
    return names.select(F.col("name").alias("n"), S.safe_name(F.col("name")).alias("safe"))


ASKS = ["./src1/en", "/src2", "src3/de/", "././src4/fr//", "12.txt", "nothing/here", "src5/en/5.txt", "/"]
NORM = """(SELECT ord, ask, CASE WHEN rtrim(b, '/') = '' THEN substr(b, 1, 1) ELSE rtrim(b, '/') END AS norm FROM
  (SELECT ord, ask, regexp_replace(regexp_replace(ask, '^([.]/)+', ''), '^/', '') AS b FROM {v}))"""


WRITTEN = f"""(SELECT entry_id AS ord, concat(CASE entry_id % 4 WHEN 0 THEN './' WHEN 1 THEN '/' WHEN 2 THEN '././' ELSE '' END, name,
  CASE entry_id % 3 WHEN 0 THEN '//' WHEN 1 THEN '/' ELSE '' END) AS ask FROM {DOCS} UNION ALL SELECT ord, ask FROM {_sql_values('ask', ASKS)})"""


@query(f"SELECT ask, norm FROM {NORM.format(v=WRITTEN)}")
def normalise_ask(spark, sf_dir):
    i = F.col("entry_id")
    front = F.when(i % 4 == 0, "./").when(i % 4 == 1, "/").when(i % 4 == 2, "././").otherwise("")
    end = F.when(i % 3 == 0, "//").when(i % 3 == 1, "/").otherwise("")
    asks = _docs(spark, sf_dir).select(F.concat(front, "name", end).alias("ask")).unionByName(_literal(spark, "ask", ASKS).select("ask"))
    return asks.select("ask", S.normalise_ask(F.col("ask")).alias("norm"))


MATCH = "(name = norm OR regexp_extract(name, '([^/]*)$', 1) = norm OR starts_with(name, concat(norm, '/')))"


@query(f"SELECT name, size FROM {DOCS} d WHERE EXISTS (SELECT 1 FROM {NORM.format(v=_sql_values('ask', ASKS))} a WHERE {MATCH})")
def extract_match(spark, sf_dir):
    return C.select_asked(_docs(spark, sf_dir), _literal(spark, "ask", ASKS)).select("name", "size")


@query(f"SELECT ask FROM {NORM.format(v=_sql_values('ask', ASKS))} a WHERE NOT EXISTS (SELECT 1 FROM {DOCS} d WHERE {MATCH})")
def extract_unmatched(spark, sf_dir):
    return C.unmatched(_docs(spark, sf_dir), _literal(spark, "ask", ASKS)).select("ask")


@query(f"SELECT name FROM {DOCS} WHERE name <> (SELECT min(name) FROM {DOCS})")
def exclude_self(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return C.exclude_self(docs, docs.agg(F.min("name").alias("name")), "name").select("name")


@query(f"""SELECT host, entry_id FROM (SELECT split_part(name, '/', 1) AS host, entry_id, row_number() OVER (PARTITION BY split_part(name, '/', 1) ORDER BY entry_id) AS n FROM {PAGES}) WHERE n = 1""")
def drop_dup_names(spark, sf_dir):
    rows = _pages(spark, sf_dir).select(F.split_part(F.col("name"), F.lit("/"), F.lit(1)).alias("host"), "entry_id")
    return C.drop_duplicate_names(rows, "host", ["entry_id"])


BUCKET = "CAST(len(list_filter(range(0, 40), lambda k: (size >> k) > {unit})) AS INTEGER)"


@query(f"""SELECT name, ext, bucket, row_number() OVER (ORDER BY ext, bucket, name) - 1 AS place FROM
  (SELECT name, lower(regexp_extract(name, '([.][^./]*)$', 1)) AS ext, {BUCKET.format(unit=1048576)} AS bucket FROM {DOCS})""")
def compression_order(spark, sf_dir):
    ordered = C.compression_order(_docs(spark, sf_dir)).select("name", "ext", "bucket")
    return C.dense_ids(ordered, ["ext", "bucket", "name"], "place")


@query(f"SELECT entry_id, {BUCKET.format(unit=1024)} AS bucket FROM {DOCS}")
def size_bucket(spark, sf_dir):
    return _docs(spark, sf_dir).select("entry_id", S.size_bucket(F.col("size"), 1024).alias("bucket"))


@query("""SELECT l_suppkey, total, CASE WHEN total < 4194304 THEN '2MiB' WHEN total < 16777216 THEN '4MiB' ELSE '16MiB' END AS tier
FROM (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) * 1000 AS BIGINT) AS total FROM lineitem GROUP BY 1)""")
def dict_tier(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.sum(F.col("l_quantity").cast("long")) * 1000).alias("total"))
    return totals.select("l_suppkey", "total", S.dict_tier(F.col("total")).alias("tier"))


@query(f"""SELECT entry_id, lang, CAST(coalesce(sum(size) OVER (PARTITION BY lang ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS region_offset
FROM (SELECT *, split_part(name, '/', 2) AS lang FROM {DOCS})""")
def chunk_offsets(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("entry_id", F.split_part(F.col("name"), F.lit("/"), F.lit(2)).alias("lang"), F.col("size").alias("n_bytes"))
    return C.region_offsets(rows, ["lang"], "entry_id").select("entry_id", "lang", "region_offset")


@query(f"""SELECT entry_id, grp, CAST(running AS BIGINT) AS running FROM (SELECT entry_id, split_part(name, '/', 1) AS grp,
  sum(size) OVER (PARTITION BY split_part(name, '/', 1) ORDER BY entry_id) AS running FROM {DOCS} WHERE size BETWEEN 200 AND 131072) WHERE running <= 50000""")
def running_budget(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("entry_id", F.split_part(F.col("name"), F.lit("/"), F.lit(1)).alias("grp"), "size")
    return C.running_budget(rows, ["grp"], "entry_id", "size", 50_000, 200, 131_072).select("entry_id", "grp", "running")


@query(f"""SELECT entry_id, n - 1 AS number, CAST((n - 1) // CAST(ceil(total / 8.0) AS BIGINT) AS BIGINT) AS group_id
FROM (SELECT entry_id, row_number() OVER (ORDER BY entry_id) AS n, count(*) OVER () AS total FROM {DOCS})""")
def group_assignment(spark, sf_dir):
    rows = C.dense_ids(_docs(spark, sf_dir).select("entry_id"), ["entry_id"], "number")
    total = rows.agg(F.count("*").alias("total"))
    return C.contiguous_groups(rows.crossJoin(F.broadcast(total)), "number", F.col("total"), 8).select("entry_id", "number", "group_id")


@query("""SELECT o_orderkey, CASE WHEN first <> o_orderkey THEN first END AS link
FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders)""")
def hardlink_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return C.hard_links(rows, ["o_custkey"], "o_orderkey", "o_orderkey").select("o_orderkey", "link")


@query("""SELECT a.o_orderkey AS entry, coalesce(b.o_totalprice, a.o_totalprice) AS price FROM orders a
LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - a.o_orderkey % 3 AND b.o_orderkey % 2 = 0""")
def hardlink_resolve(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_totalprice").alias("price"))
    linked = rows.withColumn("link", F.col("entry") - F.col("entry") % 3)
    return C.resolve_links(linked, rows.where("entry % 2 = 0"), "link", "entry", ["price"]).select("entry", "price")


@query("SELECT CAST(max(l_orderkey + CAST(l_quantity AS BIGINT)) AS BIGINT) AS scan_end FROM lineitem WHERE l_returnflag = 'R'")
def scan_range(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return C.scan_range(rows.withColumn("size", F.col("l_quantity").cast("long")), "l_orderkey", "size")


@query(f"""SELECT entry_id, size FROM (SELECT entry_id, size, sum(size) OVER (ORDER BY entry_id) - size AS before FROM {DOCS}) WHERE before < 100000""")
def history_prefix(spark, sf_dir):
    return C.history_prefix(_docs(spark, sf_dir).select("entry_id", "size"), "entry_id", "size", 100_000).select("entry_id", "size")


@query(f"""SELECT name, ext, size, row_number() OVER (ORDER BY ext, name) - 1 AS place FROM
  (SELECT name, lower(regexp_extract(name, '([.][^./]*)$', 1)) AS ext, size FROM {DOCS})""")
def wide_order(spark, sf_dir):
    """Numbers of rows that carry their whole contents through the sort."""
    rows = _docs(spark, sf_dir).withColumn("ext", S.extension(F.col("name")))
    return C.dense_ids(rows, ["ext", "name"], "place").select("name", "ext", F.octet_length("content").cast("long").alias("size"), "place")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def ordered_assemble(spark, sf_dir):
    return C.assemble(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@query("""SELECT o_orderkey, want, coalesce(got, 0) AS got FROM (SELECT o_orderkey, 1 + o_orderkey % 7 AS want FROM orders) o
LEFT JOIN (SELECT l_orderkey, count(*) AS got FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE want <> coalesce(got, 0)""")
def verify_logical(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("want"))
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("one"))
    return C.logical_mismatches(parents, children, "o_orderkey", "want", "one").select("o_orderkey", "want", "got")


@query("""SELECT o_custkey, n, coalesce(got, 0) AS got FROM (SELECT c_custkey AS o_custkey, 10 AS n FROM customer) c
LEFT JOIN (SELECT o_custkey, count(*) AS got FROM orders GROUP BY 1) o USING (o_custkey) WHERE n <> coalesce(got, 0)""")
def verify_counts(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(10).alias("n"))
    return C.count_mismatches(expected, table(spark, sf_dir, "orders"), "o_custkey", "n").select("o_custkey", "n", "got")


@query("SELECT count(*) AS n_dangling FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 2 = 0)")
def verify_fk(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.dangling(table(spark, sf_dir, "lineitem"), orders, "l_orderkey").agg(F.count("*").alias("n_dangling"))


@query(f"SELECT entry_id, size AS n_bytes FROM {DOCS} WHERE size > 8192")
def verify_bounds(spark, sf_dir):
    return C.out_of_bounds(_docs(spark, sf_dir).select("entry_id", F.col("size").alias("n_bytes")), 8192)


@query("SELECT max(CASE WHEN doc_id % 50 = 7 THEN 12 WHEN doc_id % 10 = 3 THEN 11 WHEN doc_id % 5 = 2 THEN 9 ELSE 8 END) AS version FROM documents")
def required_version(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flags = docs.select(
        F.when(F.col("doc_id") % 50 == 7, 8).otherwise(0).alias("file_xform"),
        F.when(F.col("doc_id") % 10 == 3, "hardlink").otherwise("file").alias("kind"),
        F.when(F.col("doc_id") % 5 == 2, 1_500_000_001).otherwise(0).cast("long").alias("mtime_ns"),
    )
    return C.required_version(flags)


@query(f"""SELECT tab, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT 'documents' AS tab, size FROM {DOCS}
UNION ALL SELECT 'pages', size FROM {PAGES} UNION ALL SELECT 'conversations', strlen(text) FROM conversations) GROUP BY tab""")
def union_catalog(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("tab"), F.octet_length("text").cast("long").alias("size"))
    docs, pages = (f(spark, sf_dir).select(F.lit(n).alias("tab"), "size") for f, n in ((_docs, "documents"), (_pages, "pages")))
    return docs.unionByName(pages).unionByName(conversations).groupBy("tab").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"SELECT name AS path, entry_id AS ord, 4 AS n FROM {DOCS}")
def distinct_inputs(spark, sf_dir):
    """Each name written in four ways is one input."""
    docs = _docs(spark, sf_dir).select("entry_id", "name")
    ways = F.array("name", F.concat(F.lit("./"), "name"), F.concat("name", F.lit("/")), F.regexp_replace("name", "/", "//"))
    written = docs.select((F.col("entry_id")).alias("ord"), F.explode(ways).alias("path"))
    clean = written.select(C.clean_path(F.col("path")).alias("path"), "ord")
    return clean.groupBy("path").agg(F.min("ord").alias("ord"), F.count("*").cast("int").alias("n"))


ENTROPY = """(SELECT doc_id, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS entropy, sum(c) AS n FROM
  (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"SELECT doc_id, round(entropy, 5) AS entropy FROM {ENTROPY}")
def byte_entropy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return B.byte_entropy(rows, "doc_id", "content").select("doc_id", F.round("entropy", 5).alias("entropy"))


@query(f"SELECT doc_id, entropy > 4.5 AS stored FROM {ENTROPY}")
def store_raw_classifier(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return B.byte_entropy(rows, "doc_id", "content").select("doc_id", B.store_raw(F.col("entropy"), F.col("n"), 4.5).alias("stored"))


V = "CAST(floor(value * 100) AS BIGINT) % 256"
VP = f"(({V}) + 256) % 256"


@query(f"""SELECT event_id, (v - coalesce(lag(v, 2) OVER (PARTITION BY user_id ORDER BY event_id), 0) + 256) % 256 AS delta
FROM (SELECT event_id, user_id, {VP} AS v FROM events)""")
def delta_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.pmod(F.floor(F.col("value") * 100), F.lit(256)).alias("v"))
    return B.delta_encode(rows, ["user_id"], "event_id", "v", 2).select("event_id", "delta")


@query(f"SELECT user_id, place, v AS value FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, {VP} AS v FROM events)")
def delta_decode(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("place"), F.pmod(F.floor(F.col("value") * 100), F.lit(256)).alias("v"))
    encoded = B.delta_encode(rows, ["user_id"], "place", "v", 3).select("user_id", "place", "delta")
    return B.delta_decode(encoded, ["user_id"], "place", "delta", 3).select("user_id", "place", "value")


GRID = "SELECT p_partkey // 1000 AS image, p_partkey % 1000 // 40 AS y, p_partkey % 40 AS x, p_size * 5 % 256 AS v FROM part"


@query(f"""WITH g AS ({GRID}), n AS (SELECT g.*, coalesce(l.v, 0) AS l, coalesce(u.v, 0) AS u, coalesce(c.v, 0) AS c FROM g
  LEFT JOIN g l ON l.image = g.image AND l.y = g.y AND l.x = g.x - 1 LEFT JOIN g u ON u.image = g.image AND u.y = g.y - 1 AND u.x = g.x
  LEFT JOIN g c ON c.image = g.image AND c.y = g.y - 1 AND c.x = g.x - 1)
SELECT image, y, x, CAST((v - CASE WHEN c >= greatest(l, u) THEN least(l, u) WHEN c <= least(l, u) THEN greatest(l, u) ELSE l + u - c END + 512) % 256 AS BIGINT) AS residual FROM n""")
def med_predict(spark, sf_dir):
    key = F.col("p_partkey")
    grid = table(spark, sf_dir, "part").select(
        F.floor(key / 1000).alias("image"), F.floor(key % 1000 / 40).alias("y"), (key % 40).alias("x"), (F.col("p_size") * 5 % 256).cast("long").alias("v")
    )
    return B.med_predict(grid, ["image"], "y", "x", "v").select("image", "y", "x", "residual")


@query("""SELECT p_partkey, CAST(p_size AS BIGINT) AS d0, (p_partkey % 256 - p_size + 256) % 256 AS d1,
  (CAST(p_retailprice AS BIGINT) % 256 - p_size + 256) % 256 AS d2 FROM part""")
def rct_transform(spark, sf_dir):
    price = F.col("p_retailprice")
    whole = F.bround(price, 0).cast("long")
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("c0"), F.col("p_size").cast("long").alias("c1"), (whole % 256).alias("c2"))
    return B.rct(rows, "c0", "c1", "c2").select("p_partkey", "d0", "d1", "d2")


@query("""SELECT doc_id, cand, size FROM (SELECT doc_id, cand, (n_chars * (cand + 3)) % 97 AS size,
  row_number() OVER (PARTITION BY doc_id ORDER BY (n_chars * (cand + 3)) % 97, cand) AS n FROM documents, range(0, 6) r(cand)) WHERE n = 1""")
def argmin_candidate(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("cand"))
    sized = each.withColumn("size", F.col("n_chars") * (F.col("cand") + 3) % 97)
    return C.argmin_candidate(sized, "doc_id", "size", "cand", ["cand", "size"])


SAMPLE = "concat(" + ", ".join(f"substr(h, 2 * {k} * ((n - 4096) // 7) + 1, 8192)" for k in range(8)) + ")"


@query(f"""SELECT doc_id, sha256(unhex(CASE WHEN n <= 32768 THEN h ELSE {SAMPLE} END)) AS digest
FROM (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents)""")
def strided_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(B.strided_sample(F.col("text").cast("binary"), F.octet_length("text"), 32_768), 256).alias("digest"))


G = "(b * b * 40503 + b * 30011 + 12345 + b // 7 * 9973) % 65536"
TAPS = " + ".join(f"{1 << k} * coalesce(lag(g, {k}) OVER w, 0)" for k in range(1, 10))


@query(f"""SELECT doc_id, place FROM (SELECT doc_id, place, (g + {TAPS}) % 1024 AS h FROM (SELECT doc_id, place, {G} AS g FROM
  (SELECT doc_id, place, CAST(CAST(concat('0x', x) AS INTEGER) AS BIGINT) AS b FROM
    (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x, CAST(generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) - 1 AS BIGINT) AS place
     FROM documents))) WINDOW w AS (PARTITION BY doc_id ORDER BY place)) WHERE h = 0 AND place >= 9""")
def cdc_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return B.cut_candidates(rows, "doc_id", "content", 10).withColumnRenamed("at", "place")


@query("""SELECT m.name AS mode, m.code, m.codec FROM (VALUES ('fast', 0, 'zstd'), ('best', 1, 'zstd'), ('max', 2, 'lzma2'), ('ultra', 3, 'lzma2'), ('text', 4, 'cm'), ('?', 9, 'none')) m(name, code, codec)""")
def mode_names(spark, sf_dir):
    rows = spark.createDataFrame([(c, k) for c, k, *_ in S.MODES.values()] + [(9, "none")], "code int, codec string")
    return rows.select(S.mode_name(F.col("code")).alias("mode"), "code", "codec")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN event_id * 1000000000 ELSE event_id * 1000 + 5 END AS nano,
  event_id % 4 < 2 AS plain FROM events""")
def time_fields(spark, sf_dir):
    i = F.col("event_id")
    stored = F.when(i % 4 < 2, F.lit(0)).otherwise(i * 1000 + 5)
    seconds = F.when(i % 4 == 1, i).otherwise(0)
    nano = S.entry_nano(stored.cast("long"), seconds.cast("long"))
    return table(spark, sf_dir, "events").select("event_id", nano.alias("nano"), S.fits_old_time(nano).alias("plain"))
