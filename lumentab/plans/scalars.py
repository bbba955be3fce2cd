"""Scalar functions applied to table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentab.functions import arrays as A
from lumentab.functions import dates as D
from lumentab.functions import numbers as N
from lumentab.functions import patterns as P
from lumentab.functions import sky as S
from lumentab.functions import strings as X
from lumentab.operators.sampling import top_rows
from lumentab.plans.registry import query
from lumentab.plans.statistics import r

c = F.col

_WORDS = "(SELECT DISTINCT UNNEST(string_split(text, ' ')) AS w FROM conversations)"


def words(t):
    return t.conversations.select(F.explode(F.split("text", " ")).alias("w")).distinct()


def joined(a):
    return F.array_join(a.cast("array<string>"), ",", "null")


# --- strings ---------------------------------------------------------------

@query("str_case", "C1", "SELECT p_partkey, UPPER(p_name) AS up, LOWER(p_brand) AS low FROM part")
def str_case(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"))


@query("str_title", "C2", """
SELECT p_partkey, UPPER(SUBSTR(p_name, 1, 1)) || LOWER(SUBSTR(p_name, 2)) AS cap,
 array_to_string(list_transform(string_split(p_name || '''s', ' '), lambda w: UPPER(w[1]) || LOWER(w[2:])), ' ') AS title FROM part""")
def str_title(t):
    return t.part.select("p_partkey", X.capitalize(c("p_name")).alias("cap"),
                         X.title_words(F.concat("p_name", F.lit("'s"))).alias("title"))


@query("str_len", "C3", "SELECT doc_id, LENGTH(text) AS n FROM documents")
def str_len(t):
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("str_split", "C4", """
SELECT c_custkey, string_split(c_name, '#')[1] AS head, string_split(c_name, '#')[2] AS tail, string_split(c_name, '#')[10] AS beyond,
 CAST(LEN(string_split(c_name, '0')) AS INTEGER) AS pieces FROM customer""")
def str_split(t):
    name = c("c_name")
    return t.customer.select("c_custkey", X.piece(name, "#", 0).alias("head"), X.piece(name, "#", 1).alias("tail"),
                             X.piece(name, "#", 9).alias("beyond"), F.size(F.split(name, "0")).alias("pieces"))


@query("str_slice", "C5", """
SELECT p_partkey, SUBSTR(p_name, 4) AS from3, RIGHT(p_name, 2) AS last2, REVERSE(p_name) AS backwards, SUBSTR(p_name, 2, 3) AS mid FROM part""")
def str_slice(t):
    n = c("p_name")
    return t.part.select("p_partkey", F.substring(n, F.lit(4), F.length(n)).alias("from3"), F.right(n, F.lit(2)).alias("last2"),
                         F.reverse(n).alias("backwards"), F.substring(n, 2, 3).alias("mid"))


@query("str_contains", "C6", """
SELECT doc_id, contains(text, 'the') AS has, starts_with(text, 'The') AS starts, ends_with(text, '.') AS ends FROM documents""")
def str_contains(t):
    x = c("text")
    return t.documents.select("doc_id", x.contains("the").alias("has"), x.startswith("The").alias("starts"), x.endswith(".").alias("ends"))


@query("str_find", "C7", """
SELECT conv_id, turn, CAST(strpos(text, 'the') - 1 AS INTEGER) AS pos, CAST(LEN(string_split(text, 'er')) - 1 AS INTEGER) AS n_er,
 CASE WHEN contains(text, ',') THEN string_split(text, ',')[1] ELSE text END AS head,
 CASE WHEN contains(text, ',') THEN ',' ELSE '' END AS sep,
 CASE WHEN contains(text, ',') THEN SUBSTR(text, strpos(text, ',') + 1) ELSE '' END AS tail FROM conversations""")
def str_find(t):
    head, sep, tail = X.partition(c("text"), ",")
    return t.conversations.select("conv_id", "turn", X.find(c("text"), "the").alias("pos"), X.count_substring(c("text"), "er").alias("n_er"),
                                  head.alias("head"), sep.alias("sep"), tail.alias("tail"))


@query("str_build", "C8, C14", """
SELECT p_partkey, p_brand || '/' || p_type AS both_, REPEAT('z', p_size) AS zs, REPLACE(p_name, ' ', '_') AS snake,
 p_brand || ' ' || p_name AS full_name, array_to_string([p_brand, p_type, p_name], '-') AS dashed FROM part""")
def str_build(t):
    return t.part.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("both_"), F.repeat(F.lit("z"), c("p_size")).alias("zs"),
                         F.replace("p_name", F.lit(" "), F.lit("_")).alias("snake"), X.full_name(c("p_brand"), c("p_name")).alias("full_name"),
                         F.array_join(F.array("p_brand", "p_type", "p_name"), "-").alias("dashed"))


@query("str_class", "C9", rf"""
SELECT w, regexp_full_match(w, '[\p{{L}}\p{{N}}]+') AS alnum, regexp_full_match(w, '\p{{L}}+') AS alpha, regexp_full_match(w, '[\s\p{{Z}}]+') AS space,
 regexp_matches(w, '\p{{Ll}}') AND NOT regexp_matches(w, '[\p{{Lu}}\p{{Lt}}]') AS lower_,
 regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '[\p{{Ll}}\p{{Lt}}]') AS upper_,
 regexp_full_match(w, '([^\p{{Lu}}\p{{Ll}}]*\p{{Lu}}\p{{Ll}}*)+[^\p{{Lu}}\p{{Ll}}]*') AS title_ FROM {_WORDS}""".replace(
     "'([^\\p{Lu}\\p{Ll}]*\\p{Lu}\\p{Ll}*)+[^\\p{Lu}\\p{Ll}]*'",
     "'[^\\p{Lu}\\p{Ll}]*\\p{Lu}\\p{Ll}*([^\\p{Lu}\\p{Ll}]+\\p{Lu}\\p{Ll}*)*[^\\p{Lu}\\p{Ll}]*'"))
def str_class(t):
    w = c("w")
    return words(t).select("w", X.is_alnum(w).alias("alnum"), X.is_alpha(w).alias("alpha"), X.is_space(w).alias("space"),
                           X.is_lower(w).alias("lower_"), X.is_upper(w).alias("upper_"), X.is_title(w).alias("title_"))


@query("letter_counts", "C10", r"""
SELECT doc_id, CAST(LEN(regexp_extract_all(text, '\p{Lu}')) AS INTEGER) AS upper_n, CAST(LEN(regexp_extract_all(text, '\p{Ll}')) AS INTEGER) AS lower_n FROM documents""")
def letter_counts(t):
    return t.documents.select("doc_id", X.upper_count(c("text")).alias("upper_n"), X.lower_count(c("text")).alias("lower_n"))


@query("str_format", "C12", "SELECT c_custkey, 'customer ' || c_custkey || ' in ' || c_mktsegment || ' of nation ' || c_nationkey AS line FROM customer")
def str_format(t):
    return t.customer.select("c_custkey", F.format_string("customer %d in %s of nation %d", "c_custkey", "c_mktsegment", "c_nationkey").alias("line"))


@query("email_domain", "C13", r"""
SELECT host, COUNT(*) AS n FROM (SELECT string_split(e, '@')[-1] AS host FROM
 (SELECT UNNEST(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS e FROM documents))
GROUP BY host ORDER BY n DESC, host LIMIT 5""")
def email_domain(t):
    found = t.documents.select(F.explode(P.find_all(c("text"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).alias("e"))
    hosts = found.groupBy(X.email_host(c("e")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return top_rows(hosts, 5, c("n").desc(), c("host"))


@query("str_trim", "C15", """
SELECT o_orderkey, TRIM('  ' || o_orderpriority || ' ') AS both_, LTRIM('  ' || o_orderpriority || ' ') AS left_, RTRIM('  ' || o_orderpriority || ' ') AS right_,
 CASE WHEN starts_with(o_orderpriority, '1-') THEN SUBSTR(o_orderpriority, 3) ELSE o_orderpriority END AS no_prefix,
 CASE WHEN ends_with(o_orderpriority, 'LOW') THEN LEFT(o_orderpriority, LENGTH(o_orderpriority) - 3) ELSE o_orderpriority END AS no_suffix FROM orders""")
def str_trim(t):
    p = c("o_orderpriority")
    wide = F.concat(F.lit("  "), p, F.lit(" "))
    return t.orders.select("o_orderkey", F.trim(wide).alias("both_"), F.ltrim(wide).alias("left_"), F.rtrim(wide).alias("right_"),
                           X.remove_prefix(p, "1-").alias("no_prefix"), X.remove_suffix(p, "LOW").alias("no_suffix"))


@query("str_pad", "C16", """
SELECT p_partkey, p_name || REPEAT('.', GREATEST(12 - LENGTH(p_name), 0)) AS left_, REPEAT('*', GREATEST(12 - LENGTH(p_name), 0)) || p_name AS right_,
 REPEAT('=', CAST(FLOOR(GREATEST(12 - LENGTH(p_name), 0) / 2) AS BIGINT)) || p_name || REPEAT('=', CAST(CEIL(GREATEST(12 - LENGTH(p_name), 0) / 2) AS BIGINT)) AS centre,
 printf('%10.2f', p_retailprice) AS money FROM part""")
def str_pad(t):
    n = c("p_name")
    return t.part.select("p_partkey", X.pad_right(n, 12, ".").alias("left_"), X.pad_left(n, 12, "*").alias("right_"),
                         X.pad_centre(n, 12, "=").alias("centre"), F.format_string("%10.2f", "p_retailprice").alias("money"))


@query("count_term", "C17", r"""
SELECT doc_id, CAST(LEN(list_filter(regexp_split_to_array(LOWER(text), '[ \t\n\r\f\x{0b}]+'), lambda w: w = 'the')) AS INTEGER) AS n FROM documents""")
def count_term(t):
    return t.documents.select("doc_id", X.count_term(c("text"), "The").alias("n"))


# --- patterns --------------------------------------------------------------

# the telephone layout of the test documents; the library default is P.PHONE
_PHONE = r"\((\d{3})\) (\d{3})-(\d{4})"


@query("regex_search", "G1", rf"""
SELECT doc_id, m, CAST(strpos(text, m) - 1 AS INTEGER) AS start_, CAST(strpos(text, m) - 1 + LENGTH(m) AS INTEGER) AS end_ FROM
 (SELECT doc_id, text, NULLIF(regexp_extract(text, 't[a-z]+e'), '') AS m FROM documents)""")
def regex_search(t):
    m, s = P.first_match(c("text"), "t[a-z]+e"), P.match_start(c("text"), "t[a-z]+e")
    return t.documents.select("doc_id", m.alias("m"), s.alias("start_"), (s + F.length(m)).alias("end_"))


@query("regex_findall", "G2", r"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '\d+'), ',') AS numbers, CAST(LEN(regexp_extract_all(text, 'the')) AS INTEGER) AS n_the FROM documents""")
def regex_findall(t):
    return t.documents.select("doc_id", F.array_join(P.find_all(c("text"), r"\d+"), ",").alias("numbers"),
                              F.regexp_count("text", F.lit("the")).alias("n_the"))


@query("regex_explode", "G3", r'''SELECT page_id, UNNEST(regexp_extract_all(html, 'href="[^"]*"')) AS link FROM pages''')
def regex_explode(t):
    return t.pages.select("page_id", F.explode(P.find_all(c("html"), 'href="[^"]*"')).alias("link"))


@query("regex_groups", "G4", rf"""
SELECT doc_id, CASE WHEN hit THEN regexp_extract(text, p, 1) END AS area, CASE WHEN hit THEN regexp_extract(text, p, 2) END AS exchange,
 CASE WHEN hit THEN regexp_extract(text, p, 3) END AS line FROM (SELECT doc_id, text, p, regexp_matches(text, p) AS hit FROM
 (SELECT *, '{_PHONE}' AS p FROM documents))""")
def regex_groups(t):
    return t.documents.select("doc_id", *[P.group(c("text"), _PHONE, k).alias(n) for k, n in ((1, "area"), (2, "exchange"), (3, "line"))])


@query("regex_classes", "G5", r"""
SELECT doc_id, regexp_matches(text, 'the|und') AS alternation, regexp_matches(text, '^[A-Z]') AS anchored, regexp_matches(text, '\d\.?$') AS ends_digit,
 array_to_string(regexp_extract_all(text, '[A-Za-z0-9_]+-[A-Za-z0-9_]+'), ',') AS hyphened,
 LENGTH(regexp_replace(text, '[!.? ]', '', 'g')) AS without_marks FROM documents""")
def regex_classes(t):
    x = c("text")
    return t.documents.select("doc_id", x.rlike("the|und").alias("alternation"), x.rlike("^[A-Z]").alias("anchored"),
                              x.rlike(r"\d\.?\z").alias("ends_digit"), F.array_join(P.find_all(x, P.HYPHEN_WORD), ",").alias("hyphened"),
                              F.length(F.regexp_replace(x, "[!.? ]", "")).cast("bigint").alias("without_marks"))


@query("scan_phone", "G6", rf"""
SELECT doc_id, regexp_extract(text, '{_PHONE}') AS hit FROM documents WHERE regexp_matches(text, '{_PHONE}')""")
def scan_phone(t):
    return P.scan_first(t.documents, "doc_id", "text", _PHONE)


# --- dates -----------------------------------------------------------------

@query("ts_parse", "E1", """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def ts_parse(t):
    text = F.when(c("event_id") % 10 != 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise("not a time")
    return t.events.select("event_id", F.date_format(D.parse_ts(text, "dd/MM/yyyy HH:mm:ss"), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("ts_parts", "E2", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(month(ts) AS INTEGER) AS m, CAST(isodow(ts) - 1 AS INTEGER) AS d FROM events")
def ts_parts(t):
    return t.events.select("event_id", F.hour("ts").alias("h"), F.month("ts").alias("m"), F.weekday("ts").alias("d"))


@query("ts_date", "E3", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def ts_date(t):
    return t.events.select("event_id", F.to_date("ts").alias("day"))


@query("date_arith", "E4", """
SELECT o_orderkey, CAST(DATE_DIFF('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
 CAST(TRY_CAST('2001' || strftime(o_orderdate, '-%m-%d') AS DATE) AS VARCHAR) AS moved FROM orders""")
def date_arith(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"),
                           D.replace_year(d, 2001).cast("string").alias("moved"))


@query("date_parts", "E5", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d,
 CAST(DATE_DIFF('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS INTEGER) AS ordinal FROM orders""")
def date_parts(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), D.ordinal(d).alias("ordinal"))


# --- numbers ---------------------------------------------------------------

@query("math_arith", "M1", """
SELECT event_id, a + b AS plus_, a - b AS minus_, a * b AS times_, CASE WHEN b <> 0 THEN a / b END AS divide_, POW(a, 3) AS power_,
 CASE WHEN b <> 0 THEN CAST(FLOOR(a / b) AS BIGINT) END AS floordiv_, CASE WHEN b <> 0 THEN CAST(a - b * FLOOR(a / b) AS BIGINT) END AS mod_
FROM (SELECT event_id, event_id - 500 AS a, user_id - 75 AS b FROM events)""")
def math_arith(t):
    a, b = c("a"), c("b")
    return t.events.select("event_id", (c("event_id") - 500).alias("a"), (c("user_id") - 75).alias("b")).select(
        "event_id", (a + b).alias("plus_"), (a - b).alias("minus_"), (a * b).alias("times_"), F.try_divide(a, b).alias("divide_"),
        F.pow(a, F.lit(3)).alias("power_"), N.floor_div(a, b).alias("floordiv_"), N.modulo(a, b).alias("mod_"))


@query("math_ufunc", "M2", """
SELECT event_id, ROUND(SQRT(v), 6) AS s, ROUND(EXP(v / 100), 6) AS e, ROUND(LN(v), 6) AS l, ROUND(LOG2(v), 6) AS l2,
 ROUND(SIN(v), 6) + 0.0 AS sn, ROUND(DEGREES(v), 6) AS deg, ROUND(RADIANS(v), 6) AS rad FROM (SELECT event_id, value + 0.001 AS v FROM events)""")
def math_ufunc(t):
    v = c("v")
    return t.events.select("event_id", (c("value") + 0.001).alias("v")).select(
        "event_id", r(F.sqrt(v)).alias("s"), r(F.exp(v / 100)).alias("e"), r(F.ln(v)).alias("l"), r(F.log(2.0, v)).alias("l2"),
        r(F.sin(v)).alias("sn"), r(F.degrees(v)).alias("deg"), r(F.radians(v)).alias("rad"))


@query("math_round", "M3", """
SELECT event_id, CAST(FLOOR(value) AS BIGINT) AS f, CAST(CEIL(value) AS BIGINT) AS ce, round_even(event_id / 2, 0) AS half,
 CAST(round_even(event_id, -2) AS BIGINT) AS hundreds FROM events""")
def math_round(t):
    return t.events.select("event_id", F.floor("value").alias("f"), F.ceil("value").alias("ce"), N.round_half_even(c("event_id") / 2).alias("half"),
                           N.round_half_even(c("event_id"), -2).alias("hundreds"))


@query("math_misc", "M4", """
SELECT c_custkey, ABS(c_acctbal) AS a, CAST(SIGN(c_acctbal) AS DOUBLE) AS s, UPPER(to_hex(c_custkey)) AS hx, to_binary(c_custkey) AS bn FROM customer""")
def math_misc(t):
    return t.customer.select("c_custkey", F.abs("c_acctbal").alias("a"), F.sign("c_acctbal").alias("s"), F.hex("c_custkey").alias("hx"), F.bin("c_custkey").alias("bn"))


@query("map_expr", "M5", "SELECT event_id, ROUND(value * 1.8::DOUBLE + 32, 6) AS fahrenheit FROM events")
def map_expr(t):
    return t.events.select("event_id", r(N.fahrenheit(c("value"))).alias("fahrenheit"))


@query("sexagesimal", "M6", """
SELECT c_custkey, ROUND((h + m / 60 + s / 3600) * 15, 6) AS ra, ROUND(CASE WHEN neg THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (d + m / 60 + s / 3600), 6) + 0.0 AS dec
FROM (SELECT c_custkey, c_custkey % 24 AS h, c_custkey % 60 AS m, c_custkey % 59 + 0.5 AS s, c_custkey % 90 AS d, c_custkey % 2 = 1 AS neg FROM customer)""")
def sexagesimal(t):
    k = c("c_custkey")
    degree_text = F.concat(F.when(k % 2 == 1, "-").otherwise("+"), F.lpad((k % 90).cast("string"), 2, "0"))
    return t.customer.select("c_custkey", r(S.hms_to_degrees(k % 24, k % 60, k % 59 + 0.5)).alias("ra"),
                             r(S.dms_to_degrees(degree_text, k % 60, k % 59 + 0.5)).alias("dec"))


@query("angular_dist", "M7", """
SELECT c_custkey, ROUND(DEGREES(2 * ASIN(SQRT(LEAST(POW(SIN(ABS(d1 - d2) / 2), 2) + COS(d1) * COS(d2) * POW(SIN(ABS(r1 - r2) / 2), 2), 1.0::DOUBLE)))), 6) AS dist
FROM (SELECT c_custkey, RADIANS((c_custkey * 7.25::DOUBLE) % 360) r1, RADIANS(c_custkey % 181 - 90) d1, RADIANS(21.07::DOUBLE) r2, RADIANS(0.1::DOUBLE) d2 FROM customer)""")
def angular_dist(t):
    k = c("c_custkey")
    dist = S.angular_distance(k * F.lit(7.25) % 360, (k % 181 - 90).cast("double"), F.lit(21.07), F.lit(0.1))
    return t.customer.select("c_custkey", r(dist).alias("dist"))


@query("parallax_distance", "M8", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN ROUND(1000 / (c_acctbal / 100), 6) END AS pc FROM customer")
def parallax_distance(t):
    return t.customer.select("c_custkey", r(S.parallax_distance_pc(c("c_acctbal") / 100)).alias("pc"))


@query("luminosity", "M9", """
SELECT s_suppkey, ROUND(4 * PI() * 5.670374419e-8 * POW(6.957e8::DOUBLE * (1 + s_nationkey), 2) * POW(5000.0::DOUBLE + s_suppkey, 4) / 1e26, 6) AS l_1e26w FROM supplier""")
def luminosity(t):
    watt = S.luminosity_watt(F.lit(6.957e8) * (1 + c("s_nationkey")), 5000.0 + c("s_suppkey"))
    return t.supplier.select("s_suppkey", r(watt / 1e26).alias("l_1e26w"))


@query("colour_index", "M10", """
SELECT vec_id, e[1] - e[2] AS u_g, e[2] - e[3] AS g_r, e[3] - e[4] AS r_i, e[4] - e[5] AS i_z, ROUND(e[6] / e[7], 6) + 0.0 AS conc
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def colour_index(t):
    mags = [F.get("embedding", F.lit(k)).cast("double") for k in range(7)]
    return t.embeddings.select("vec_id", *[x.alias(n) for n, x in S.colour_indices(*mags[:5]).items()], r(S.concentration(mags[5], mags[6])).alias("conc"))


@query("line_geometry", "M11", """
SELECT s_suppkey, ROUND(SQRT(POW(x2 - x1, 2) + POW(y2 - y1, 2)), 6) AS len, CASE WHEN x2 <> x1 THEN ROUND((y2 - y1) / (x2 - x1), 6) + 0.0 END AS slope FROM
 (SELECT s_suppkey, 3.0::DOUBLE AS x1, 2.0::DOUBLE AS y1, CAST(s_nationkey AS DOUBLE) AS x2, s_acctbal AS y2 FROM supplier)""")
def line_geometry(t):
    p = (F.lit(3.0), F.lit(2.0), c("s_nationkey").cast("double"), c("s_acctbal"))
    return t.supplier.select("s_suppkey", r(N.line_length(*p)).alias("len"), r(N.line_slope(*p)).alias("slope"))


# --- arrays and maps -------------------------------------------------------

_ARR = """(SELECT vec_id, label, list_transform(CAST(embedding[1:8] AS DOUBLE[]), lambda x: CAST(FLOOR(x * 30) AS BIGINT)) AS a,
 list_transform(CAST(embedding[9:14] AS DOUBLE[]), lambda x: CAST(FLOOR(x * 30) AS BIGINT)) AS b FROM embeddings)"""


def lists(t):
    def ints(first, n):
        return F.transform(F.slice("embedding", first, n), lambda x: F.floor(x.cast("double") * 30))
    return t.embeddings.select("vec_id", "label", ints(1, 8).alias("a"), ints(9, 6).alias("b"))


@query("array_basic", "Y1", f"""
SELECT vec_id, a[1] AS first_, a[-1] AS last_, array_to_string(a[2:4], ',') AS slice_, array_to_string(list_append(a, label), ',') AS appended,
 array_to_string(a || b, ',') AS both_, array_to_string(list_reverse(a), ',') AS reversed_, array_to_string(list_sort(a), ',') AS sorted_ FROM {_ARR}""")
def array_basic(t):
    return lists(t).select(
        "vec_id", F.element_at("a", 1).alias("first_"), F.element_at("a", -1).alias("last_"), joined(F.slice("a", 2, 3)).alias("slice_"),
        joined(F.array_append("a", c("label").cast("bigint"))).alias("appended"), joined(F.concat("a", "b")).alias("both_"),
        joined(F.reverse("a")).alias("reversed_"), joined(F.array_sort("a")).alias("sorted_"))


@query("array_edit", "Y2", f"""
SELECT vec_id, CAST(LEN(list_filter(a, lambda x: x = 0)) AS INTEGER) AS n0, CASE WHEN p > 0 THEN CAST(p - 1 AS BIGINT) END AS idx,
 array_to_string(CASE WHEN p > 0 THEN a[1:p - 1] || a[p + 1:] ELSE a END, ',') AS removed, array_to_string(a[1:2] || [CAST(99 AS BIGINT)] || a[3:], ',') AS inserted,
 array_to_string(a[1:7], ',') AS popped, a[8] AS pop_value FROM (SELECT *, COALESCE(list_position(a, 0), 0) AS p FROM {_ARR})""")
def array_edit(t):
    zero = F.lit(0).cast("bigint")
    rest, last = A.pop_last(c("a"))
    return lists(t).select(
        "vec_id", A.count_value(c("a"), zero).alias("n0"), A.index_of(c("a"), zero).alias("idx"), joined(A.remove_first(c("a"), zero)).alias("removed"),
        joined(F.array_insert("a", 3, F.lit(99).cast("bigint"))).alias("inserted"), joined(rest).alias("popped"), last.alias("pop_value"))


@query("array_hof", "Y3", f"""
SELECT vec_id, array_to_string(list_transform(a, lambda x: x * x), ',') AS squares, array_to_string(list_filter(a, lambda x: x % 2 = 0), ',') AS evens,
 array_to_string(list_transform(list_filter(a, lambda x: x > 0), lambda x: x + 1), ',') AS both_ FROM {_ARR}""")
def array_hof(t):
    return lists(t).select(
        "vec_id", joined(F.transform("a", lambda x: x * x)).alias("squares"), joined(F.filter("a", lambda x: x % 2 == 0)).alias("evens"),
        joined(F.transform(F.filter("a", lambda x: x > 0), lambda x: x + 1)).alias("both_"))


@query("array_zip", "Y4", f"""
SELECT vec_id, array_to_string(list_transform(range(1, 7), lambda i: a[i] || ':' || b[i]), ',') AS zipped,
 array_to_string(list_transform(range(0, 8), lambda i: i || '=' || a[i + 1]), ',') AS enumerated,
 CAST(LEN(list_filter(range(0, 8), lambda i: a[i + 1] = i)) AS INTEGER) AS n_index_match FROM {_ARR}""")
def array_zip(t):
    pairs = F.transform(A.zip_shortest(c("a"), c("b")), lambda p: F.concat_ws(":", p["a"].cast("string"), p["b"].cast("string")))
    numbered = F.transform("a", lambda x, i: F.concat_ws("=", i.cast("string"), x.cast("string")))
    hits = F.size(F.filter(F.transform("a", lambda x, i: x == i), lambda ok: ok))
    return lists(t).select("vec_id", F.array_join(pairs, ",").alias("zipped"), F.array_join(numbered, ",").alias("enumerated"), hits.alias("n_index_match"))


@query("array_any_all", "Y5", f"""
SELECT label, bool_or(any_big) AS any_big, bool_and(all_small) AS all_small, CAST(SUM(any_big::INT) AS BIGINT) AS n_any FROM
 (SELECT label, len(list_filter(a, lambda x: x > 7)) > 0 AS any_big, len(list_filter(a, lambda x: x >= 12)) = 0 AS all_small FROM {_ARR}) GROUP BY label""")
def array_any_all(t):
    df = lists(t).select("label", F.exists("a", lambda x: x > 7).alias("any_big"), F.forall("a", lambda x: x < 12).alias("all_small"))
    return df.groupBy("label").agg(F.bool_or("any_big").alias("any_big"), F.bool_and("all_small").alias("all_small"),
                                   F.count_if(c("any_big")).alias("n_any"))


@query("array_reduce", "Y6", f"""
SELECT vec_id, list_reduce(list_transform(a[1:5], lambda x: CAST(x + 20 AS DOUBLE)), lambda x, y: x * y) AS prod,
 CAST(list_reduce(list_transform(a[1:6], lambda x: abs(x) % 10), lambda x, y: x * 10 + y) AS BIGINT) AS number FROM {_ARR}""")
def array_reduce(t):
    return lists(t).select(
        "vec_id", A.product(F.transform(F.slice("a", 1, 5), lambda x: (x + 20).cast("double"))).alias("prod"),
        A.digits_to_number(F.transform(F.slice("a", 1, 6), lambda x: F.abs(x) % 10)).alias("number"))


@query("words_hof", "Y7", """
SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w: LENGTH(w)), ',') AS lengths,
 array_to_string(list_filter(string_split(text, ' '), lambda w: starts_with(w, 't')), ',') AS t_words FROM conversations""")
def words_hof(t):
    w = F.split("text", " ")
    return t.conversations.select("conv_id", "turn", joined(F.transform(w, lambda x: F.length(x))).alias("lengths"),
                                  F.array_join(F.filter(w, lambda x: x.startswith("t")), ",").alias("t_words"))


@query("map_basic", "Y9", """
SELECT o_orderkey, o_orderstatus AS got, CAST(NULL AS VARCHAR) AS absent, 'status,priority' AS keys_, o_orderstatus || ',' || o_orderpriority AS vals,
 'status=' || o_orderstatus || ',priority=' || o_orderpriority AS items, o_custkey AS nested FROM orders""")
def map_basic(t):
    m = c("m")
    df = t.orders.select("o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("m"),
                         F.struct(F.struct(F.array(F.lit(0).cast("bigint"), "o_custkey").alias("list")).alias("inner")).alias("deep"))
    return df.select("o_orderkey", F.element_at(m, "status").alias("got"), F.try_element_at(m, F.lit("none")).alias("absent"),
                     F.array_join(F.map_keys(m), ",").alias("keys_"), F.array_join(F.map_values(m), ",").alias("vals"),
                     F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("items"),
                     F.get("deep.inner.list", F.lit(1)).alias("nested"))


@query("map_build", "Y10", """
SELECT vec_id, COALESCE(a[label + 1], -999) AS by_label, 'v' || label AS switched FROM (SELECT vec_id, label, a FROM X)""".replace("X", _ARR))
def map_build(t):
    pairs = F.map_from_entries(F.transform("a", lambda x, i: F.struct(i.alias("k"), x.alias("v"))))
    names = F.map_from_arrays(F.array(*[F.lit(f"v{k}") for k in range(10)]), F.array(*[F.lit(k) for k in range(10)]))
    return lists(t).select("vec_id", A.get_default(pairs, c("label"), F.lit(-999).cast("bigint")).alias("by_label"),
                           F.element_at(A.switch_map(names), c("label")).alias("switched"))


@query("array_minmax", "Y11", f"SELECT vec_id, list_min(a) AS lo, list_max(a) AS hi, list_contains(a, 3) AS has3 FROM {_ARR}")
def array_minmax(t):
    return lists(t).select("vec_id", F.array_min("a").alias("lo"), F.array_max("a").alias("hi"), F.array_contains("a", F.lit(3).cast("bigint")).alias("has3"))
