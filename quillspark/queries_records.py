"""Queries over whole records and files: pseudonyms, parts and pages of files, differences, registries, ledgers and sketches.

As in ``queries``, documents come from the driver's tables and the SQL computes the results from the tables, never from a text.
"""

from __future__ import annotations

import io
import itertools
import shutil
import tempfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from quillspark.operators.comparing import FIELDS, accuracy_cube, long_matches, with_matches
from quillspark.operators.diffing import differences
from quillspark.operators.glyphs import text_lines
from quillspark.operators.pseudonyms import field_mentions, pseudonymized, replaced_everywhere, text_mentions, token_table
from quillspark.plans import synth
from quillspark.plans.parse import parse_documents
from quillspark.plans.ledger import parse_new, parsed_of
from quillspark.plans.pages import first_hits, joined_pages, page_texts
from quillspark.plans.registry import as_of, in_ranges
from quillspark.plans.sketches import batch_sketches, merged_sketches
from quillspark.sources.parts import register_parts
from quillspark.sources.scratch import saved, scratch_path
from quillspark.streaming.totals import late_rows, stream_totals

_PADDED = "CASE WHEN {n} < 1000 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


def pseudonymize_texts(spark, sf_dir):
    """Orders told as texts; companies, dates, numbers and money replaced by their tokens."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.lit("购买方 客户"), F.col("o_custkey").cast("string"), F.lit("科技有限公司 日期 "), F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 360), "yyyy年MM月dd日"),
                    F.lit(" 号码 "), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit(" 金额 ¥"), F.col("o_totalprice").cast("decimal(20,2)").cast("string"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    mentions = saved(text_mentions(docs), "mentions")
    return pseudonymized(docs, token_table(mentions), mentions)


def sanitize_records(spark, sf_dir):
    """Whole records of rail tickets and their texts; the values of sensitive fields are replaced wherever they stand."""
    docs = synth.rendered(spark, sf_dir, "rail")
    records = saved(parse_documents(docs.select("k", "text", F.col("text").alias("said"))).select("k", "data", F.col("said").alias("text")), "records")
    mentions = saved(field_mentions(records, "k"), "mentions")
    clean = pseudonymized(records, token_table(mentions, "k"), mentions, "k")
    d, r = F.col("data"), F.col("data.extra.rail_12306")
    whole = F.concat(F.to_json("data"), "text")
    told = F.array(d["buyer"]["name"], d["invoice_number"], r["passenger_name"])
    return clean.select(
        "k", d["buyer"]["name"].alias("buyer"), d["invoice_number"].alias("invoice_number"), r["passenger_name"].alias("passenger"), r["id_no_masked"].alias("id_no"),
        d["amount_with_tax"].alias("gross"), F.forall(told, lambda x: F.col("text").contains(x)).alias("text_told"),
        (~(whole.contains("客户") | whole.contains("张三"))).alias("text_clean"))


def names_everywhere(spark, sf_dir):
    """Names of customers replaced wherever they stand in the documents of others, by automata over slices of the names."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    tokens = c.select(F.col("c_name").alias("value"), F.concat(F.lit("<"), F.col("c_custkey").cast("string"), F.lit(">")).alias("token"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(c, F.col("o_custkey") == F.col("c_custkey"))
    body = F.struct(F.concat(F.lit("to "), "c_name", F.lit("/"), "c_name").alias("to"), F.array(F.col("c_name"), F.lit("other")).alias("names"))
    records = o.select(F.col("o_orderkey").alias("k"), body.alias("body"))
    most = max(1, c.count() // 3)  # three slices and more
    out = replaced_everywhere(records, tokens, ["body"], lambda df: saved(df, "names"), most)
    return out.select("k", F.col("body.to").alias("to_text"), F.col("body.names")[0].alias("first_name"), F.col("body.names")[1].alias("other_name"))


def _pack(pack: int, orders: Iterable[tuple[int, int, str]], out: BinaryIO) -> None:
    """Writes a file of orders: a container for even numbers, a PDF with a stream an order for odd ones, a cut-off container for every ninth of the even."""
    said = ((k, f"<o><k>{k}</k><price>{price}</price></o>".encode()) for _, k, price in orders)
    if pack % 2:
        out.write(b"%PDF-1.7\n")
        for k, data in said:
            out.write(b"%d 0 obj\n<< /Filter /FlateDecode >>\nstream\n" % k + zlib.compress(data) + b"\nendstream\nendobj\n")
    else:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
            box.writestr("OFD.xml", "<o/>")
            for k, data in said:
                box.writestr(f"Doc_{k}/page.xml", data)
    out.seek(0, io.SEEK_END)
    out.truncate(out.tell() // 2 if pack % 18 == 0 else out.tell())


def document_parts(spark, sf_dir):
    """Orders packed into files by customer, read again as the parts of those files."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = o.select((F.col("o_custkey") % 100).alias("pack"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("price"))
    root = scratch_path(spark, "packs")
    packs = orders.repartition("pack").sortWithinPartitions("pack")  # a file's orders stream through its task

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pafs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for pack, orders in itertools.groupby(rows, key=lambda row: row[0]):
            with tempfile.TemporaryFile() as out, system.open_output_stream(f"{folder}/pack_{pack}.bin") as f:
                _pack(pack, orders, out)
                out.seek(0)
                shutil.copyfileobj(out, f, 1 << 20)
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64())], names=["pack"])

    packs.mapInArrow(write, "pack long").count()
    register_parts(spark)
    parts = spark.read.format("document_parts").option("partitionBytes", 4 << 20).option("pattern", r".*\.bin").load(root)
    pack = F.regexp_extract("path", r"pack_(\d+)\.bin$", 1).cast("long").alias("pack")
    price = F.regexp_extract("text", "<price>([0-9.]+)</price>", 1)
    cents = F.when(price != "", F.round(price.cast("decimal(20,2)") * 100).cast("long"))
    return parts.groupBy(pack, "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(cents), F.lit(0).cast("long")).alias("cents"))


def _page_reader():
    def read(page: bytes) -> str:
        text = page.decode()
        if int(text.split(" ")[0]) % 5 == 0:
            raise ValueError("blurred")
        return text

    return read


def pages_of_files(spark, sf_dir):
    """Files with a page an order line, whose pages fail one by one."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    page = F.concat(F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_suppkey").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), page.alias("page"))))
    files = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(rows, lambda r: r["page"]), "\f").cast("binary").alias("content"))
    return joined_pages(page_texts(files, "k", lambda content: content.split(b"\f"), _page_reader), "k")


def codes_of_files(spark, sf_dir):
    """The first code in files with a page an order line: whole pages first, then their ends, up to the first hit."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    page = F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), page.alias("page"))))
    files = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(rows, lambda r: r["page"]), "\f").cast("binary").alias("content"))
    ladder = [("whole", lambda page: page.split(b":")[0]), ("end", lambda page: page.split(b":")[1])]

    def reader():
        return lambda data: data.decode() if data.endswith(b"7") else None

    return first_hits(files, "k", lambda content: content.split(b"\f"), ladder, reader).drop("error")


def _order_records(spark, sf_dir):
    """Orders with their lines as nested records, by key."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("k"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")).alias("x"))
    items = lines.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("items"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.struct(F.col("o_custkey").cast("string").alias("id")).alias("buyer"))
    return o.join(items, "k").select("k", F.struct("buyer", "items").alias("data"))


def record_differences(spark, sf_dir):
    """Differences planted in orders' records: a buyer, a line less, a line more, a changed price; some records gone."""
    expected = _order_records(spark, sf_dir)
    d, k = F.col("data"), F.col("k")
    more = F.struct(F.lit(99).alias("line"), F.lit(1).cast("long").alias("part"), F.lit(1).cast("long").alias("cents"))
    items = F.when(k % 5 == 0, F.slice(d["items"], F.lit(2), F.size(d["items"]))).when(k % 5 == 1, F.concat(d["items"], F.array(more))).when(
        k % 5 == 2, F.transform(d["items"], lambda x, i: F.when(i == 0, x.withField("cents", x["cents"] + 1)).otherwise(x))).otherwise(d["items"])
    buyer = F.when(k % 7 == 0, F.struct(F.lit("?").alias("id"))).otherwise(d["buyer"])
    actual = expected.where(k % 11 != 0).withColumn("data", F.struct(buyer.alias("buyer"), items.alias("items")))
    return differences(expected, actual, "k").select("k", "path", "kind")


def accuracy_by_all(spark, sf_dir):
    """Matches of predictions by model, part of the documents and field, and all their sums."""
    from quillspark.queries import _predictions

    expected, guessed = _predictions(spark, sf_dir)
    m = with_matches(guessed, expected, "k").withColumns({"model": F.when(F.col("k") % 2 == 0, "even").otherwise("odd"), "part": F.col("k") % 3})
    return accuracy_cube(long_matches(m, ["model", "part"]), ["model", "part"])


def glyph_lines(spark, sf_dir):
    """Glyphs of order lines, without the lines' numbers and out of order: lines again, in reading order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    chars = lines.select("l_orderkey", "l_linenumber", F.posexplode(F.split(F.col("p").cast("string"), "")).alias("position", "char")).where("char <> ''")
    y0 = F.col("l_linenumber") * 12.0 + F.col("position") % 3
    boxes = chars.withColumns({"x0": F.col("position") * 6.0, "x1": F.col("position") * 6.0 + 5.0, "y0": y0, "y1": y0 + 8.0})
    return text_lines(boxes.select("l_orderkey", "x0", "y0", "x1", "y1", "char"), ["l_orderkey"]).select("l_orderkey", "line", "x1", "y1", "text")


def states_as_of(spark, sf_dir):
    """Each order line with the customer's last order at the time that the line was sent."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    registry = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("since"), F.col("o_orderkey").alias("last_order"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    records = lines.select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("cust"), F.col("l_shipdate").alias("sent"))
    return as_of(records, registry, "cust", "sent", "since", ["last_order"])


def bands_of_orders(spark, sf_dir):
    """For each order, how many suppliers' bands its price lies in, and the first of them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    low = F.col("s_suppkey").cast("long") * 37_000
    bands = s.select("s_suppkey", low.alias("low"), (low + 500_000 + F.col("s_suppkey") % 10 * 100_000).alias("high"))
    return in_ranges(o, bands, "cents", "low", "high").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("s_suppkey").cast("long").alias("first_band"))


def incremental_runs(spark, sf_dir):
    """Two runs over QR payloads of orders: all but some, then all, some of them changed, each payload parsed once."""
    docs = saved(synth.invoices(spark, sf_dir).select("k", synth.qr().alias("qr_payload")), "payloads")  # all runs read them
    changed = docs.withColumn("qr_payload", F.when(F.col("k") % 10 == 0, F.concat("qr_payload", F.lit(",x"))).otherwise(F.col("qr_payload")))
    out, content = scratch_path(spark, "ledger"), F.col("qr_payload")
    for run, rows in enumerate([docs.where(F.col("k") % 3 != 0), changed, changed]):
        parse_new(rows, out, lambda df, run=run: parse_documents(df).withColumn("run", F.lit(run)), content, "1")
    found = parsed_of(changed.select(F.col("k").alias("doc"), "qr_payload"), out, content, "1")
    return found.select("doc", "run", "status", F.col("data.invoice_number").alias("invoice_number"))


def sketched_batches(spark, sf_dir):
    """Sketches of sixteen batches of orders, merged to four; the estimates lie within their bounds of the exact figures."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 16).alias("batch"), "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    stored = saved(batch_sketches(o, ["batch"], "o_custkey", "cents"), "sketches").withColumn("part", F.col("batch") % 4)
    told = merged_sketches(stored, ["part"], [0.5, 0.95])
    exact = o.groupBy((F.col("batch") % 4).alias("part")).agg(F.count_distinct("o_custkey").alias("exact_distinct"))
    q = F.col("quantiles")
    ranks = o.withColumn("part", F.col("batch") % 4).join(F.broadcast(told.select("part", "quantiles")), "part").groupBy("part").agg(  # four rows
        F.avg((F.col("cents") <= q[0]).cast("int")).alias("half"), F.avg((F.col("cents") <= q[1]).cast("int")).alias("most"))
    both = told.join(exact, "part").join(ranks, "part")
    return both.select("part", "n", "exact_distinct", (F.abs(F.col("n_distinct") - F.col("exact_distinct")) <= 0.03 * F.col("exact_distinct") + 1).alias("distinct_near"),
                       ((F.abs(F.col("half") - 0.5) <= 0.02) & (F.abs(F.col("most") - 0.95) <= 0.02)).alias("quantiles_near"))



def streamed_totals(spark, sf_dir):
    """Events told as parsed documents in four files by time: some sent twice, some a file late, some too late to count."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))  # whatever the session's time zone
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.timestamp_micros(micros).alias("received"), F.col("event_type").alias("code"))
    first, last = e.agg(F.min(F.unix_seconds("received")), F.max(F.unix_seconds("received"))).first()
    span = (last - first) // 4 + 1
    at = F.unix_seconds("received") - first
    quarter, into = F.floor(at / span), at % span
    sent = F.when((F.col("id") % 97 == 1) & (quarter == 0), 3).when((F.col("id") % 7 == 0) & (into > span - span // 16) & (quarter < 3), quarter + 1).otherwise(quarter)
    e = e.withColumns({"digest": F.sha2(F.col("id").cast("string"), 256), "file": sent.cast("int")})
    again = e.where((F.col("id") % 10 == 0) & ~((F.col("id") % 97 == 1) & (quarter == 0)))
    rows = saved(e.unionByName(again).drop("id"), "events")
    root = scratch_path(spark, "totals")
    end = F.timestamp_seconds(F.lit(last + 20 * span))
    closing = rows.limit(1).select(end.alias("received"), F.lit("end").alias("code"), F.lit("end").alias("digest"))  # closes all windows
    late = 0
    for n in range(5):  # in the order of arrival; a quarter is a run over as many files as it needs
        (rows.where(F.col("file") == n).drop("file") if n < 4 else closing).write.parquet(f"{root}/in/{n}")
        stream = spark.readStream.schema("received timestamp, code string, digest string").parquet(f"{root}/in/*")
        query = stream_totals(stream, f"{root}/out", f"{root}/checkpoint", f"{span // 8} seconds", "1 day")
        query.awaitTermination()
        late += late_rows(query)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("opened") / 86_400).cast("int"))
    return spark.read.parquet(f"{root}/out").select(day.alias("day"), "code", "n", F.lit(late).cast("long").alias("n_late"))


QUERIES = [record_differences, accuracy_by_all, glyph_lines, states_as_of, bands_of_orders, incremental_runs, sketched_batches, streamed_totals, document_parts, pages_of_files, codes_of_files, pseudonymize_texts, sanitize_records, names_everywhere]

_PAGES = """p AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) - 1 AS page FROM lineitem)"""

SQL = {
    "record_differences": """WITH i AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k FROM orders JOIN i ON i.k = o_orderkey)
      SELECT k, '' AS path, 'missing' AS kind FROM o WHERE k % 11 = 0
      UNION ALL SELECT k, 'buyer.id', 'changed' FROM o WHERE k % 11 <> 0 AND k % 7 = 0
      UNION ALL SELECT k, 'items[0]', 'missing' FROM o WHERE k % 11 <> 0 AND k % 5 = 0
      UNION ALL SELECT k, 'items[' || n || ']', 'extra' FROM i JOIN o USING (k) WHERE k % 11 <> 0 AND k % 5 = 1
      UNION ALL SELECT k, 'items[0].cents', 'changed' FROM o WHERE k % 11 <> 0 AND k % 5 = 2""",
    "accuracy_by_all": f"""WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
      m AS (SELECT CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS model, k % 3 AS part, field,
        CASE field WHEN 'invoice_number' THEN k % 5 <> 0 WHEN 'buyer.name' THEN k % 7 <> 0 ELSE true END AS ok FROM k, unnest({FIELDS}) AS f(field))
      SELECT model, part, field, count(*) AS total, count(*) FILTER (WHERE ok) AS matched, CAST(grouping(model, part, field) AS BIGINT) AS level FROM m GROUP BY CUBE (model, part, field)""",
    "glyph_lines": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(min(l_partkey) AS VARCHAR) AS text FROM lineitem GROUP BY 1, 2)
      SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS line, CAST(length(text) * 6 - 1 AS DOUBLE) AS x1,
      CAST(l_linenumber * 12 + 8 + least(length(text) - 1, 2) AS DOUBLE) AS y1, text FROM l""",
    "states_as_of": """WITH r AS (SELECT o_custkey AS cust, o_orderdate AS since, max(o_orderkey) AS last_order FROM orders GROUP BY 1, 2),
      l AS (SELECT l_orderkey, l_linenumber, o_custkey AS cust, l_shipdate AS sent FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT l.*, r.last_order FROM l ASOF LEFT JOIN r ON l.cust = r.cust AND l.sent >= r.since""",
    "bands_of_orders": """WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
      b AS (SELECT s_suppkey, CAST(s_suppkey AS BIGINT) * 37000 AS low, CAST(s_suppkey AS BIGINT) * 37000 + 500000 + s_suppkey % 10 * 100000 AS high FROM supplier)
      SELECT o_orderkey, count(*) AS n, CAST(min(s_suppkey) AS BIGINT) AS first_band FROM o JOIN b ON c >= low AND c < high GROUP BY 1""",
    "incremental_runs": """WITH b AS (SELECT l_orderkey AS k, min(l_suppkey) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
      SELECT k AS doc, CAST(CASE WHEN k % 10 = 0 OR k % 3 = 0 THEN 1 ELSE 0 END AS INT) AS run, 'ok' AS status,
      '26' || lpad(CAST(k AS VARCHAR), 12, '0') || lpad(CAST(s AS VARCHAR), 6, '0') AS invoice_number FROM b""",
    "sketched_batches": """SELECT o_orderkey % 4 AS part, count(*) AS n, count(DISTINCT o_custkey) AS exact_distinct, true AS distinct_near, true AS quantiles_near FROM orders GROUP BY 1""",
    "streamed_totals": """WITH f AS (SELECT min(epoch(ts)) AS a, (CAST(max(epoch(ts)) AS BIGINT) - CAST(min(epoch(ts)) AS BIGINT)) // 4 + 1 AS span FROM events),
      e AS (SELECT *, event_id % 97 = 1 AND epoch(ts) - a < span AS late FROM events, f)
      SELECT CAST(ts AS DATE) AS day, event_type AS code, count(*) AS n, (SELECT count(*) FROM e WHERE late) AS n_late FROM e WHERE NOT late GROUP BY 1, 2""",
    "document_parts": """WITH o AS (SELECT o_custkey % 100 AS pack, CAST(round(CAST(o_totalprice AS DECIMAL(20, 2)) * 100) AS BIGINT) AS c FROM orders)
      SELECT pack, CASE WHEN pack % 18 = 0 THEN 'broken' WHEN pack % 2 = 1 THEN 'stream' ELSE 'xml' END AS kind,
      CASE WHEN pack % 18 = 0 THEN 1 WHEN pack % 2 = 1 THEN count(*) ELSE count(*) + 1 END AS n, CAST(CASE WHEN pack % 18 = 0 THEN 0 ELSE sum(c) END AS BIGINT) AS cents FROM o GROUP BY pack""",
    "pages_of_files": f"""WITH {_PAGES} SELECT k, count(*) AS n_pages, count(*) FILTER (WHERE p % 5 = 0) AS n_failed,
      string_agg(p || ' ' || s, chr(10) ORDER BY page) FILTER (WHERE p % 5 <> 0) AS text FROM p GROUP BY k""",
    "codes_of_files": f"""WITH {_PAGES}, t AS (SELECT k, page, 0 AS step, p AS x FROM p UNION ALL SELECT k, page, 1, s FROM p),
      h AS (SELECT k, min((page, step, x)) AS h FROM t WHERE x % 10 = 7 GROUP BY k), n AS (SELECT k, count(*) AS n FROM p GROUP BY k)
      SELECT n.k, CAST(h[1] AS INT) AS page, CASE h[2] WHEN 0 THEN 'whole' WHEN 1 THEN 'end' END AS attempt, CAST(h[3] AS VARCHAR) AS found,
      CAST(coalesce(h[1] * 2 + h[2] + 1, n * 2) AS INT) AS tries FROM n LEFT JOIN h ON n.k = h.k""",
    "pseudonymize_texts": f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, strftime(CAST(o_orderdate AS DATE) + INTERVAL 30 YEAR, '%Y-%m-%d') AS d, CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR) AS m FROM orders),
      cs AS (SELECT c, row_number() OVER (ORDER BY min(k)) AS n FROM o GROUP BY c), ds AS (SELECT d, row_number() OVER (ORDER BY min(k)) AS n FROM o GROUP BY d),
      ms AS (SELECT m, row_number() OVER (ORDER BY min(k)) AS n FROM o GROUP BY m), ks AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM o GROUP BY k)
      SELECT k AS doc_id, '购买方 脱敏主体' || {_PADDED.format(n='cs.n')} || '有限公司 日期 ' || strftime(DATE '2026-01-01' + CAST(ds.n - 1 AS INT), '%Y年%m月%d日')
      || ' 号码 ' || lpad(CAST(ks.n AS VARCHAR), 10, '0') || ' 金额 ¥' || CAST(CAST(100 + ms.n * 7.13 AS DECIMAL(20, 2)) AS VARCHAR) AS text
      FROM o JOIN cs USING (c) JOIN ds USING (d) JOIN ms USING (m) JOIN ks USING (k)""",
    "sanitize_records": f"""WITH l AS (SELECT l_orderkey AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem),
      g AS (SELECT k, CAST(sum(c) AS BIGINT) AS net FROM l GROUP BY k), b AS (SELECT g.*, o_custkey AS cust FROM g JOIN orders ON o_orderkey = k),
      cs AS (SELECT cust, 1 + row_number() OVER (ORDER BY min(k)) AS n FROM b GROUP BY cust)  -- the railway is the first company
      SELECT k, '脱敏主体' || {_PADDED.format(n='cs.n')} || '有限公司' AS buyer, lpad(CAST(row_number() OVER (ORDER BY k) AS VARCHAR), 20, '0') AS invoice_number,
      '测试人员001' AS passenger, '110000********0001' AS id_no, (net // 100) || '.' || lpad(CAST(net % 100 AS VARCHAR), 2, '0') AS gross, true AS text_told, true AS text_clean
      FROM b JOIN cs USING (cust)""",
    "names_everywhere": """SELECT o_orderkey AS k, 'to <' || o_custkey || '>/<' || o_custkey || '>' AS to_text, '<' || o_custkey || '>' AS first_name, 'other' AS other_name
      FROM orders JOIN customer ON o_custkey = c_custkey""",
}
