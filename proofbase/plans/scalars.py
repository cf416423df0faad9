"""Queries of projections, predicates and scalar functions (P, F and the parsing sources) on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbase.functions import codes, web
from proofbase.functions import text as tx
from proofbase.operators import records
from proofbase.plans.registry import Tables, query

NORM = r"array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+'), ' ')"
TOK = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+')"
STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS_LATIN) + "]"
TERMS_SQL = f"list_distinct(list_transform(list_filter({TOK}, lambda w: NOT list_contains({STOP}, w) AND NOT regexp_full_match(w, '[0-9]+') AND length(w) >= 3), lambda w: CASE WHEN length(w) > 4 AND w[-1:] = 's' THEN w[:-2] ELSE w END))"


def normed(t: Tables) -> DataFrame:
    return t.documents.withColumn("norm", tx.normalized(F.col("text")))


@query("F01_strip_controls", r"SELECT doc_id, regexp_replace(text || chr(8203) || chr(7) || chr(9), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g') AS clean FROM documents")
def f01(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.strip_controls(F.concat("text", F.lit("​\x07\t"))).alias("clean"))


@query("F02_normalize_text", f"SELECT doc_id, {NORM} AS norm FROM documents")
def f02(t: Tables) -> DataFrame:
    return normed(t).select("doc_id", "norm")


@query("F02_normalize_exact", f"SELECT doc_id, {NORM} AS norm FROM documents")
def f02_exact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.normalized_exact(F.col("text")).alias("norm"))


@query("F03_extract_terms", f"SELECT doc_id, list_sort({TERMS_SQL}) AS terms FROM documents")
def f03(t: Tables) -> DataFrame:
    return normed(t).select("doc_id", F.sort_array(tx.extract_terms(F.col("norm"))).alias("terms"))


@query(
    "F04_record_query_terms",
    f"SELECT doc_id, array_to_string(list_concat(list_sort({TERMS_SQL}), list_filter(list_sort(list_distinct({TOK})), lambda w: regexp_full_match(w, '[0-9][0-9]+'))), ' ') AS terms FROM (SELECT doc_id, text || ' 17 alpha' AS text FROM documents)",
)
def f04(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", tx.normalized(F.concat("text", F.lit(" 17 alpha"))).alias("n"))
    terms = found.select("doc_id", tx.record_query_terms(F.col("n")).alias("terms"))
    numbers = terms.select("doc_id", "terms", tx.numbers(F.array_join("terms", " ")).alias("numbers"))
    return numbers.select("doc_id", F.array_join(F.concat(F.array_except("terms", "numbers"), F.sort_array("numbers")), " ").alias("terms"))


@query("F05_document_query_terms", f"SELECT doc_id, list_sort(list_distinct(list_filter({TOK}, lambda w: NOT list_contains({STOP}, w) AND (regexp_full_match(w, '[0-9]+') OR length(w) >= 2)))) AS terms FROM documents")
def f05(t: Tables) -> DataFrame:
    return normed(t).select("doc_id", F.sort_array(tx.document_query_terms(F.col("norm"))).alias("terms"))


WANTED = ("tion", "ering", "haea", "one", "that", "2024", "ble")
WANTED_SQL = "[" + ", ".join(f"'{w}'" for w in WANTED) + "]"
MATCHED_SQL = f"list_filter({WANTED_SQL}, lambda q: list_contains(v, q) OR len(list_filter(v, lambda w: starts_with(w, q) AND length(w) - length(q) <= 3)) > 0)"


def _wanted() -> F.Column:
    return F.array(*[F.lit(w) for w in WANTED])


SUFFIXES_SQL = "[" + ", ".join(f"'{x}'" for x in tx.SUFFIXES) + "]"


@query(
    "F06_hebrew_match",
    f"""WITH r AS (SELECT a.term, p.p || a.term || s.s AS token FROM (SELECT unnest(['תקנה', 'רכב', 'מכס', 'יבוא']) AS term) a, (SELECT unnest(['', 'ה', 'ול', 'והמש', 'x']) AS p) p, (SELECT unnest(['', 'ות', 'ימ', 'zz']) AS s) s),
    t AS (SELECT *, unnest(CASE WHEN right(term, 1) = 'ה' THEN [term, left(term, length(term) - 1) || 'ת', left(term, length(term) - 1)] ELSE [term] END) AS stem FROM r),
    m AS (SELECT *, instr(token, stem) AS i FROM t)
    SELECT term, token, bool_or(i BETWEEN 1 AND 4 AND regexp_full_match(left(token, i - 1), '[{tx.PROCLITICS}]*') AND list_contains({SUFFIXES_SQL}, substr(token, i + length(stem)))) AS hit FROM m GROUP BY 1, 2""",
)
def f06(t: Tables) -> DataFrame:
    """Hebrew inflections; the driver tables have none, so words are paired with prefixes and suffixes here."""
    pairs = [(a, p + a + s) for a in ("תקנה", "רכב", "מכס", "יבוא") for p in ("", "ה", "ול", "והמש", "x") for s in ("", "ות", "ימ", "zz")]
    return t.spark.createDataFrame(pairs, "term string, token string").withColumn("hit", tx.hebrew_match(F.col("term"), F.col("token")))


@query("F07_F08_matched_terms", f"SELECT doc_id, {MATCHED_SQL} AS got FROM (SELECT doc_id, list_distinct({TOK}) AS v FROM documents)")
def f08(t: Tables) -> DataFrame:
    return normed(t).select("doc_id", tx.matched_terms(_wanted(), F.array_distinct(tx.tokens(F.col("norm")))).alias("got"))


@query("F09_document_hits", f"SELECT doc_id, list_filter({WANTED_SQL}, lambda q: list_contains(v, q) OR (q <> '2024' AND len(list_filter(v, lambda w: starts_with(w, q) AND length(w) - length(q) <= 3)) > 0)) AS got FROM (SELECT doc_id, list_distinct({TOK}) AS v FROM documents)")
def f09(t: Tables) -> DataFrame:
    return normed(t).select("doc_id", tx.document_hits(_wanted(), F.array_distinct(tx.tokens(F.col("norm")))).alias("got"))


@query("F10_F11_index_terms", f"SELECT doc_id, list_sort(list_distinct({TOK})) AS terms FROM documents")
def f11(t: Tables) -> DataFrame:
    return normed(t).select("doc_id", F.sort_array(tx.index_terms(F.col("norm"))).alias("terms"))


@query("F12_prefix_query", f"SELECT item_id, array_to_string(list_transform(list_sort(list_distinct({TOK})), lambda w: '\"' || w || '\"*'), ' OR ') AS q FROM benchmark")
def f12(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", tx.prefix_query(F.array_sort(F.array_distinct(tx.tokens(tx.normalized(F.col("text")))))).alias("q"))


PADDED = "lpad(p_partkey::VARCHAR, 6, '0') || '0000'"


@query(
    "F13_F14_codes",
    f"""SELECT p_partkey, code, substr(code, 1, greatest(2, len(rtrim(code, '0'))) + greatest(2, len(rtrim(code, '0'))) % 2) AS hier FROM (SELECT p_partkey, {PADDED} AS code FROM part)""",
)
def f13(t: Tables) -> DataFrame:
    dotted = F.concat(F.expr("lpad(p_partkey, 6, '0')"), F.lit(".00.00/2"))
    return t.part.select("p_partkey", codes.normalize_code(dotted).alias("code")).withColumn("hier", codes.hierarchy_key(F.col("code")))


@query("F13_numeric_codes", "SELECT o_orderkey, CASE WHEN length((o_orderkey * 1000)::VARCHAR) BETWEEN 7 AND 9 THEN lpad((o_orderkey * 1000)::VARCHAR, 10, '0') ELSE (o_orderkey * 1000)::VARCHAR END AS code FROM orders")
def f13_numeric(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", codes.normalize_number(F.col("o_orderkey") * 1000).alias("code"))


@query("F15_code_query", r"SELECT p_partkey, CASE WHEN regexp_full_match(p_brand, '-?[0-9][0-9.\- ]*(/[0-9])?') THEN p_brand ELSE '' END AS from_brand, CASE WHEN length(p_size::VARCHAR) >= 2 THEN p_size::VARCHAR ELSE '' END AS from_size FROM part")
def f15(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", codes.code_query(F.col("p_brand")).alias("from_brand"), codes.code_query(F.col("p_size").cast("string")).alias("from_size"))


@query("F16_number_in_field", f"SELECT p_partkey, p_size = 12 AS whole_word, starts_with({PADDED}, '0001') AS in_code FROM part")
def f16(t: Tables) -> DataFrame:
    code = F.concat(F.expr("lpad(p_partkey, 6, '0')"), F.lit("0000"))
    none = F.lit("")
    return t.part.select("p_partkey", codes.number_in_field(F.lit("12"), F.col("p_size").cast("string")).alias("whole_word"), codes.number_in_field(F.lit("0001"), none, code).alias("in_code"))


@query(
    "F20_F21_standard_refs",
    r"""SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)$', 1) AS number, 'ISO' AS scheme, '1' AS part, regexp_extract(p_brand, '([0-9]+)$', 1) = '23' AS hit FROM part""",
)
def f20(t: Tables) -> DataFrame:
    named = t.part.withColumn("refs", codes.standard_refs(F.concat(F.lit("see iso/iec 0"), F.regexp_extract("p_brand", "([0-9]+)$", 1), F.lit("-1:2013 and EPEN 77"))))
    wanted = F.array(F.struct(F.lit("ISO").alias("scheme"), F.lit("23").alias("number"), F.lit("").alias("part")))
    first = F.col("refs")[0]
    return named.select("p_partkey", first["number"].alias("number"), first["scheme"].alias("scheme"), first["part"].alias("part"), codes.standard_matches(F.col("refs"), wanted).alias("hit"))


@query("F22_estimated_tokens", r"SELECT doc_id, (floor(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4 + (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / 2) + 1)::BIGINT AS tokens FROM documents")
def f22(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))


@query("F23_short", r"SELECT doc_id, CASE WHEN length(x) <= 240 THEN x ELSE substr(x, 1, 239) || '…' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)")
def f23(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.short(F.col("text")).alias("short"))


@query(
    "F25_U04_near_duplicate_items",
    f"""WITH b AS (SELECT item_id, list_distinct({TOK}) AS w FROM benchmark), s AS (SELECT item_id, unnest(w) AS w FROM b),
    p AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM s a JOIN s b ON a.w = b.w AND a.item_id < b.item_id),
    j AS (SELECT p.a, p.b, len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) AS j FROM p JOIN b x ON x.item_id = p.a JOIN b y ON y.item_id = p.b)
    SELECT a, b, round(j, 9) AS jaccard FROM j WHERE j >= 0.8""",
)
def f25(t: Tables) -> DataFrame:
    return records.near_duplicates(t.benchmark.select("item_id", F.array_distinct(tx.tokens(tx.normalized(F.col("text")))).alias("w")), "item_id", "w").withColumn("jaccard", F.round("jaccard", 9))


@query("F26_rtl_lines")
def f26(t: Tables) -> DataFrame:
    from proofbase.functions.rtl import repaired

    rows = [("םלוע םולש",), ("plain text",), ("2024 תנש )א( קוח",), ("שלום עולם",), ("",)]
    return t.spark.createDataFrame(rows, "line string").withColumn("fixed", repaired(F.col("line")))


@query("F27_F44_row_score", f"SELECT doc_id, len({MATCHED_SQL}) AS score, round(len({MATCHED_SQL}) / 7, 9) AS coverage FROM (SELECT doc_id, list_distinct({TOK}) AS v FROM documents)")
def f27(t: Tables) -> DataFrame:
    vocabulary = F.array_distinct(tx.tokens(F.col("norm")))
    got = tx.matched_terms(_wanted(), vocabulary)
    return normed(t).select("doc_id", tx.row_score(_wanted(), vocabulary).alias("score"), F.round(tx.coverage(got, _wanted()), 9).alias("coverage"))


@query("F29_markdown", r"SELECT p_partkey, regexp_replace(p_brand || '_*[' || p_type, '([\\`*_{}\[\]()#+\-.!|<>~$])', '\\\1', 'g') AS md FROM part")
def f29(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.markdown(F.concat("p_brand", F.lit("_*["), "p_type")).alias("md"))


@query(
    "F30_url_key",
    r"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) ||
    CASE WHEN rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') END ||
    regexp_extract(url, '(\?[^#]+)', 1) AS url_key FROM pages""",
)
def f30(t: Tables) -> DataFrame:
    loud = F.concat(F.upper(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)), F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1), F.lit("#part"))
    return t.pages.select("page_id", web.url_key(loud).alias("url_key"))


@query("F31_official", r"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_matches(regexp_extract(url, '://([^/?#]*)', 1), '(^|\.)(example\.org|example\.com)$') AS official FROM pages")
def f31(t: Tables) -> DataFrame:
    return t.pages.select("page_id", web.host(F.col("url")).alias("host"), web.is_official(F.col("url"), ("example.org", "example.com")).alias("official"))


@query("F32_normalized_query", r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM conversations")
def f32(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.normalized_query(F.col("text")).alias("q"))


SLUG = r"regexp_replace(list_last(string_split(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '/')), '\.[A-Za-z0-9]+$', '')"


@query("F33_slug_query", rf"SELECT page_id, trim(regexp_replace(regexp_replace(url_decode({SLUG}), '[-_+]+', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM pages")
def f33(t: Tables) -> DataFrame:
    return t.pages.select("page_id", web.slug_query(F.lit(""), F.col("url")).alias("q"))


@query("F34_metadata_url", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS meta FROM pages")
def f34(t: Tables) -> DataFrame:
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("https://x.org/api/3/action/package_show?id="), n)).when(k == 1, F.concat(F.lit("https://x.org/api/action/resource_show?id="), n)).when(k == 2, F.concat(F.lit("https://x.org/dataset/"), n)).otherwise(F.col("url"))
    return t.pages.select("page_id", web.is_metadata_url(url).alias("meta"))


@query("F35_F36_json_object", "SELECT event_id, (props->>'$.k')::BIGINT AS k, ('{' || substr(props, 2)) AS object, (props->>'$.k')::BIGINT IS NULL AS rejected FROM events")
def f35(t: Tables) -> DataFrame:
    found = t.events.withColumn("object", web.json_object(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))))
    parsed = F.from_json("object", "k bigint")
    return found.select("event_id", parsed["k"].alias("k"), "object", parsed["k"].isNull().alias("rejected"))


@query("F37_enum_value", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS status FROM events")
def f37(t: Tables) -> DataFrame:
    return t.events.select("event_id", web.enum_value(F.concat(F.lit(" "), F.upper("event_type")), ("click", "view"), "other").alias("status"))


@query(
    "F38_F39_references",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN [url] WHEN 1 THEN [url, 'http://b.org/' || page_id] ELSE [] END AS kept, page_id % 5 < 3 AS is_ref FROM pages""",
)
def f38(t: Tables) -> DataFrame:
    n, k, r = F.col("page_id").cast("string"), F.col("page_id") % 3, F.col("page_id") % 5
    items = F.when(k == 0, F.array(F.col("url"), F.lit("ftp://x"), F.lit("page 3"))).when(k == 1, F.array(F.lit("E1"), F.col("url"), F.concat(F.lit("http://b.org/"), n))).otherwise(F.array(F.lit(""), F.concat(F.lit("page "), n)))
    ref = F.when(r == 0, F.concat(F.lit("E"), n)).when(r == 1, F.concat(F.lit("F"), n)).when(r == 2, F.concat(F.lit("doc-"), F.substring(F.md5(n.cast("binary")), 1, 16))).when(r == 3, F.concat(F.lit("doc-"), n, F.lit("z"))).otherwise(F.concat(F.lit("G"), n))
    return t.pages.select("page_id", web.web_items(items).alias("kept"), web.is_evidence_ref(ref).alias("is_ref"))


@query("F40_iso_time", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, round_even((epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate)) / 86400, 1) AS age FROM orders")
def f40(t: Tables) -> DataFrame:
    then = web.iso_time(F.date_format("o_orderdate", web.ISO_FORMAT))
    return t.orders.select("o_orderkey", F.unix_timestamp(then).alias("seconds"), web.age_days(then, F.lit("2000-01-01").cast("timestamp")).alias("age"))


@query("F41_content_id", "SELECT doc_id, 'doc-' || substr(sha256(text), 1, 16) AS content_id FROM documents")
def f41(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", web.content_id(F.col("text")).alias("content_id"))


@query("F42_retry_delay", "SELECT l_orderkey, l_linenumber, least(greatest(pow(2.0, l_linenumber), l_quantity), 60.0)::DOUBLE AS delay FROM lineitem")
def f42(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", web.retry_delay(F.col("l_linenumber"), F.col("l_quantity")).alias("delay"))


@query("F43_passage_score", f"SELECT doc_id, round_even(10 * len({MATCHED_SQL}) / 7 + CASE WHEN list_contains(v, 'the') THEN 5 ELSE 0 END, 2) AS score FROM (SELECT doc_id, list_distinct({TOK}) AS v FROM documents)")
def f43(t: Tables) -> DataFrame:
    vocabulary = F.array_distinct(tx.tokens(F.col("norm")))
    got = F.size(tx.matched_terms(_wanted(), vocabulary))
    return normed(t).select("doc_id", web.passage_score(got, F.lit(7), F.array_contains(vocabulary, "the")).alias("score"))


@query("F45_page_mismatch", "SELECT o_orderkey, o_orderkey % 7 <> 3 AND o_orderkey % 7 <> 5 AS wrong, CAST(NULL AS BOOLEAN) AS none FROM orders")
def f45(t: Tables) -> DataFrame:
    pages = F.array(F.lit(3), F.lit(5))
    return t.orders.select("o_orderkey", web.page_mismatch(F.concat(F.lit("p. "), (F.col("o_orderkey") % 7).cast("string")), pages).alias("wrong"), web.page_mismatch(F.lit("none"), pages).alias("none"))


@query(
    "F46_checklist_update",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'resolved' WHEN 'view' THEN 'open' ELSE 'unresolved' END AS status FROM events",
)
def f46(t: Tables) -> DataFrame:
    asked = F.when(F.col("event_type").isin("click", "view"), " Resolved").otherwise("unresolved")
    refs = F.when(F.col("event_type") == "click", F.array(F.lit("E1"))).otherwise(F.array(F.lit("none")))
    return t.events.select("event_id", web.checklist_status(F.lit("open"), asked, refs, F.col("event_type")).alias("status"))


@query("F47_run_id", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ-') AS stamp, true AS random_hex FROM orders")
def f47(t: Tables) -> DataFrame:
    """The stamp of each order's date; the rest is random, so its form is asked."""
    made = t.orders.select("o_orderkey", web.run_id(F.col("o_orderdate").cast("timestamp")).alias("id"))
    return made.select("o_orderkey", F.substring("id", 1, 17).alias("stamp"), F.substring("id", 18, 99).rlike("^[0-9a-f]{16}$").alias("random_hex"))


LINE_SQL = "concat_ws(' | ', 'p_partkey: ' || p_partkey, CASE WHEN p_name <> '' THEN 'p_name: ' || p_name END, CASE WHEN p_brand <> '' THEN 'p_brand: ' || p_brand END, CASE WHEN p_type <> '' THEN 'p_type: ' || p_type END, 'p_size: ' || p_size)"


@query("P01_P02_record_line", f"SELECT p_partkey::VARCHAR AS record_id, 'part' AS dataset, {LINE_SQL} AS record_line FROM part")
def p01(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return records.result(rows, "part", "p_partkey").select("record_id", "dataset", "record_line")


@query("P03_get_record", "SELECT 'customer' AS dataset, k AS record_id, c_name IS NOT NULL AS found, c_name FROM (VALUES ('7'), ('-5')) v(k) LEFT JOIN customer ON c_custkey::VARCHAR = k")
def p03(t: Tables) -> DataFrame:
    return records.get_records(t.customer, "customer", "c_custkey", [" 7 ", "-5"]).select("dataset", "record_id", "found", "c_name")


@query("P06_P07_exact_filter", "SELECT c_custkey, c_name FROM customer WHERE trim(c_mktsegment) = 'BUILDING' AND trim(c_nationkey::VARCHAR) = '5'")
def p07(t: Tables) -> DataFrame:
    return records.exact_filter(t.customer, {"c_mktsegment": " BUILDING", "c_nationkey": 5}).select("c_custkey", "c_name")


@query("P08_P09_A13_scope", """WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'import' WHEN 'view' THEN 'export' ELSE 'unknown' END AS direction,
    CASE user_id % 4 WHEN 0 THEN 'autonomy_only' WHEN 1 THEN 'israel_and_autonomy' WHEN 2 THEN 'unknown' END AS jurisdiction FROM events)
    SELECT event_id, direction, jurisdiction, NOT (direction = 'export') AND coalesce(jurisdiction <> 'autonomy_only', true) AS allowed FROM s""")
def p08(t: Tables) -> DataFrame:
    shaped = t.events.select(
        "event_id", F.when(F.col("event_type") == "click", "1.0").when(F.col("event_type") == "view", "2").otherwise("9").alias("book_id"),
        F.expr("CASE user_id % 4 WHEN 0 THEN 'אוטונומיה בלבד' WHEN 1 THEN 'ישראל ואוטונומיה' WHEN 2 THEN 'אחר' END").alias("region"),
    )
    scoped = shaped.select("event_id", records.direction(F.lit(None).cast("string"), F.col("book_id")).alias("direction"), records.jurisdiction(F.col("region")).alias("jurisdiction"))
    return scoped.withColumn("allowed", records.scope_allowed(F.col("direction"), F.col("jurisdiction"), "import", "israel"))


@query("P10_dataset_restriction", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def p10(t: Tables) -> DataFrame:
    return records.restrict(t.nation.withColumn("dataset", F.col("n_regionkey").cast("string")), ["1", "3"]).select("n_nationkey", "n_name")


@query("P11_lenient_filter", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def p11(t: Tables) -> DataFrame:
    return records.lenient_filter(t.supplier, {"s_nationkey": "3", "no_such_column": "x"}).select("s_suppkey")


@query("P12_L12_bounded_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 20000) WHERE l_quantity > 30 ORDER BY l_orderkey, l_linenumber LIMIT 5")
def p12(t: Tables) -> DataFrame:
    """The scan's bound and the sample's size are the feature here."""
    scanned = records.bounded(t.lineitem, ["l_orderkey", "l_linenumber"])
    return scanned.where("l_quantity > 30").orderBy("l_orderkey", "l_linenumber").limit(5).select("l_orderkey", "l_linenumber", "l_quantity")


@query("P13_P14_rendered_rows", "SELECT s_suppkey, trim(substr(s_name || '  ', 1, 200)) || ' | ' || s_nationkey AS line FROM supplier")
def p13(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", records.rendered([F.concat("s_name", F.lit("\n ")), F.col("s_nationkey").cast("string")]).alias("line"))


@query("P15_passage_lines", r"SELECT doc_id, i - 1 AS line_no, substr(trim(line), 1, 600) AS line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' AND list_contains(regexp_extract_all(strip_accents(lower(line)), '[\p{L}\p{N}_]+'), 'thereon')")
def p15(t: Tables) -> DataFrame:
    return records.passage_lines(t.documents, F.array(F.lit("thereon")), whole_words=True).select("doc_id", "line_no", "line")


@query("P16_truthy", "SELECT event_id, event_type = 'click' AS flag FROM events")
def p16(t: Tables) -> DataFrame:
    return t.events.select("event_id", web.truthy(F.when(F.col("event_type") == "click", " Yes ").otherwise("0")).alias("flag"))


@query("P17_A10_field_terms", r"""WITH h AS (SELECT p_partkey, list_filter(['blue','steel','12'], lambda q: list_contains(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+'), q)) AS a,
    list_filter(['blue','steel','12'], lambda q: list_contains(regexp_extract_all(lower(p_type), '[\p{L}\p{N}_]+'), q)) AS b, list_filter(['blue','steel','12'], lambda q: q = p_partkey::VARCHAR) AS ids FROM part)
    SELECT p_partkey, list_sort(list_distinct(list_concat(a, b))) AS got, list_sort(list_filter(ids, lambda x: NOT list_contains(list_concat(a, b), x))) AS id_only FROM h""")
def p17(t: Tables) -> DataFrame:
    terms = F.array(F.lit("blue"), F.lit("steel"), F.lit("12"))
    found = records.field_terms(t.part, terms, ["p_name", "p_type"], ["p_partkey"], whole_words=True)
    return found.select("p_partkey", F.array_sort("got").alias("got"), F.array_sort("id_only").alias("id_only"))


@query("P18_F40_freshness", """WITH m AS (SELECT max(o_orderdate) AS now FROM orders), a AS (SELECT o_orderkey, round_even((epoch(now) - epoch(o_orderdate)) / 86400, 1) AS age FROM orders, m)
    SELECT o_orderkey, age, CASE WHEN age <= 2 THEN 'fresh' WHEN age <= 8 THEN 'aging' ELSE 'stale' END AS freshness, age <= 1 AS cached FROM a""")
def p18(t: Tables) -> DataFrame:
    now = t.orders.agg(F.max("o_orderdate").alias("now"))
    aged = t.orders.join(F.broadcast(now)).withColumn("age", web.age_days(F.col("o_orderdate"), F.col("now")))
    return aged.select("o_orderkey", "age", web.freshness(F.col("age")).alias("freshness"), (F.col("age") <= 1).alias("cached"))


@query("P21_metadata_gate", f"SELECT doc_id, len(list_filter(got, lambda q: length(q) >= 4)) > 0 OR len(got) >= 2 AS relevant FROM (SELECT doc_id, {MATCHED_SQL} AS got FROM (SELECT doc_id, list_distinct({TOK}) AS v FROM documents))")
def p21(t: Tables) -> DataFrame:
    got = tx.matched_terms(_wanted(), F.array_distinct(tx.tokens(F.col("norm"))))
    return normed(t).select("doc_id", records.metadata_relevant(got, _wanted()).alias("relevant"))


@query("P22_page_range", "SELECT conv_id, turn FROM conversations WHERE turn BETWEEN 1 AND 3")
def p22(t: Tables) -> DataFrame:
    return records.page_range(t.conversations, "turn", 1, 3).select("conv_id", "turn")


@query("P24_negative_claim", "SELECT conv_id, turn, turn % 2 = 0 AS negative FROM conversations")
def p24(t: Tables) -> DataFrame:
    said = F.when(F.col("turn") % 2 == 0, "It is NOT subject to approval").otherwise("A permit is needed")
    return t.conversations.select("conv_id", "turn", records.is_negative([said, F.col("text")]).alias("negative"))


@query(
    "P28_safe_url",
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN true WHEN 1 THEN (page_id // 8) % 200 <> 127 AND (page_id // 8) % 200 NOT IN (0, 10) WHEN 7 THEN true ELSE false END AS safe FROM pages""",
)
def p28(t: Tables) -> DataFrame:
    """Addresses made from the page's number: public ones, first octets of all kinds, private, local and named hosts, other schemes."""
    from proofbase.sources.fetch import safe_url

    n = F.floor(F.col("page_id") / 8) % 200
    forms = ["https://93.184.216.{}/x", "http://{}.8.4.4/x", "http://10.0.{}.1/", "http://127.0.0.{}/admin", "ftp://93.184.216.{}/", "http://host{}.internal/", "http://intranet{}/", "https://www{}.example.org/"]
    url = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        url = F.when(F.col("page_id") % 8 == k, F.replace(F.lit(form), F.lit("{}"), n.cast("string"))).otherwise(url)
    return t.pages.select("page_id", safe_url(url).alias("safe"))


@query(
    "S14_S16_S27_records_in_sql",
    "SELECT event_id, (props->>'$.k') AS k, 'json' AS kind, 0::BIGINT AS row_no FROM events UNION ALL SELECT event_id, event_type, 'csv', 0 FROM events UNION ALL SELECT event_id, user_id::VARCHAR, 'csv', 1 FROM events",
)
def s16(t: Tables) -> DataFrame:
    """Each event as a JSON file of one record and as a CSV file of two, read by the readers of files through SQL."""
    from proofbase.sources import functions_sql

    functions_sql.register(t.spark)
    json_file = F.concat(F.lit("[{\"k\": "), F.get_json_object("props", "$.k"), F.lit("}]"))
    files = t.events.select("event_id", F.explode(F.array(F.struct(F.lit("json").alias("kind"), json_file.alias("file")), F.struct(F.lit("csv").alias("kind"), F.concat(F.lit("other;k\nx;"), "event_type", F.lit("\n\ny;"), "user_id", F.lit("\n")).alias("file")))).alias("f"))
    files = files.select("event_id", "f.kind", F.encode("f.file", "utf-8").alias("content"))
    return t.spark.sql("SELECT event_id, cells['k'] AS k, kind, row_no FROM {files} LATERAL VIEW inline(file_rows(kind, content)) r AS sheet, row_no, cells, problem", files=files)


@query("S19_html_text")
def s19(t: Tables) -> DataFrame:
    from proofbase.sources.formats import html_title_and_text

    found = html_title_and_text(F.col("html"))
    return t.pages.select("page_id", found["title"].alias("title"), found["text"].alias("text"))


@query(
    "S20_kind",
    """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'csv' WHEN 3 THEN 'json' WHEN 4 THEN 'xlsx' WHEN 5 THEN CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'xlsx' END ELSE 'json' END AS kind FROM pages""",
)
def s20(t: Tables) -> DataFrame:
    """Content types, paths and first characters, dealt to the pages by number."""
    k, none = F.col("page_id") % 7, F.lit("")
    path = lambda x: F.concat(F.lit("https://h/"), F.col("page_id").cast("string"), F.lit(x))
    given = [("text/html", F.col("url"), F.col("html")), ("", path(".PDF?a=1"), none), ("application/vnd.ms-excel", path(".csv"), none), ("", path("?x"), F.lit("  [1]")), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", path(""), none)]
    given += [("", F.when(F.col("page_id") % 2 == 0, path("/file")).otherwise(path(".xlsm#s")), F.when(F.col("page_id") % 2 == 0, F.lit("%PDF-1.7")).otherwise(none)), ("application/json; charset=utf-8", path(".csv"), none)]
    pick = lambda i: F.coalesce(*[F.when(k == n, x[i] if i else F.lit(x[0])) for n, x in enumerate(given)])
    return t.pages.select("page_id", web.kind_of(pick(0), pick(1), pick(2)).alias("kind"))
