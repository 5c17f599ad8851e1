"""Queries of the embedded language and its function library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lang as L
from ..functions import scalar as X
from .bindings import read

Q, S = {}, {}


def add(name, query, sql):
    Q[name], S[name] = query, sql


def program(name, table, key, text, sql, digits=None):
    def query(s, d):
        out = L.evaluate(read(s, d, table), value=text).select(key, "value")
        return out.withColumn("value", F.round("value", digits)) if digits else out

    add(name, query, f"SELECT {key}, {sql} AS value FROM {table}")


program("lang_arithmetic", "part", "p_partkey", "(let ((x (* p_size 2)) (y (+ x 1))) (- (* y y) (/ p_retailprice 4)))", "round((p_size * 2 + 1) * (p_size * 2 + 1) - p_retailprice / 4, 6)", 6)
program("lang_if_logic", "part", "p_partkey", "(if (and (> p_size 10) (not (= p_size 20))) (if (or (< p_size 15) (> p_size 40)) \"edge\" \"middle\") \"small\")", "CASE WHEN p_size > 10 AND p_size <> 20 THEN CASE WHEN p_size < 15 OR p_size > 40 THEN 'edge' ELSE 'middle' END ELSE 'small' END")
program("lang_defun", "part", "p_partkey", "(defun sq (x) (* x x)) (defun hyp (a b) (math.sqrt (+ (sq a) (sq b)))) (hyp p_size 3)", "round(sqrt(p_size * p_size + 9), 6)", 6)
program("lang_defmacro", "part", "p_partkey", "(defmacro unless (c a b) (if c b a)) (unless (> p_size 25) 1 2)", "CASE WHEN p_size > 25 THEN 2 ELSE 1 END")
program("lang_map_reduce", "part", "p_partkey", "(collections.reduce (lambda (a x) (+ a x)) (* 1 p_partkey) (collections.map (lambda (x) (* x x)) (collections.filter (lambda (x) (= (% x 2) 1)) (collections.range p_size))))", "p_partkey + coalesce(list_sum([x * x FOR x IN range(p_size) IF x % 2 = 1]), 0)::BIGINT")
program("lang_strings", "part", "p_partkey", "(string.upper (string.replace (string.substring p_name 1 4) \"a\" \"_\"))", "upper(replace(substr(p_name, 2, 4), 'a', '_'))")
program("lang_split_join", "part", "p_partkey", "(string.join (collections.reverse (string.split p_type \" \")) \"-\")", "array_to_string(list_reverse(string_split(p_type, ' ')), '-')")
program("lang_sort_unique", "part", "p_partkey", "(string.join (collections.sort (collections.unique (string.split (string.lower p_name) \"\"))) \"\")", "array_to_string(list_sort(list_distinct(string_split(lower(p_name), ''))), '')")
program("lang_dict", "part", "p_partkey", "(get-attr (collections.dict-merge (dict \"a\" p_size \"b\" 1) (dict \"b\" (+ p_size 5))) \"b\")", "p_size + 5")
program("lang_lists", "part", "p_partkey", "(str (car (cdr (list p_size 7 8))) \"/\" (length (cons 1 '(2 3))) \"/\" (nth (set-nth (list 1 2 3) 1 p_size) 1) \"/\" (nth (del-nth (list 4 5 6) 0) 0))", "'7/3/' || p_size || '/5'")
program("lang_url", "conversations", "conv_id", "(sha256-hex (url-encode text))", "sha256(replace(replace(url_encode(text), '+', '%20'), '*', '%2A'))")
program("lang_sha256", "documents", "doc_id", "(sha256-hex text)", "sha256(text)")
program("lang_lengths", "documents", "doc_id", "(- (string.byte-length text) (string.length text))", "(strlen(text) - length(text))::INT")
program("lang_predicates", "pages", "page_id", "(and (string.contains url \"example\") (string.starts-with url \"https\") (not (string.ends-with url \".html\")))", "contains(url, 'example') AND starts_with(url, 'https') AND NOT ends_with(url, '.html')")
program("lang_bytes", "documents", "doc_id", "(bytes.byte-at (string.encode text) 0)", "CASE WHEN text <> '' THEN ('0x' || substr(hex(encode(text)), 1, 2))::BIGINT END")
add("lang_json", lambda s, d: read(s, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("value")), "SELECT event_id, (props->>'$.k')::BIGINT AS value FROM events")
add("lang_numbers", lambda s, d: s.createDataFrame([("12",), ("-0x1f",), ("1_000",), ("2.5e3",), ("0b101",), ("x",)], "t string").select("t", X.parse_number("t" if False else F.col("t")).alias("value")), "SELECT * FROM (VALUES ('12', 12.0::DOUBLE), ('-0x1f', -31.0), ('1_000', 1000.0), ('2.5e3', 2500.0), ('0b101', 5.0), ('x', NULL)) v(t, value)")
add("units_convert", lambda s, d: read(s, d, "part").select("p_partkey", F.round(X.convert(F.col("p_size"), "ft", "m"), 9).alias("m"), F.round(X.convert(F.col("p_size"), "degF", "degC"), 6).alias("c")), "SELECT p_partkey, round(p_size * 0.3048::DOUBLE, 9) AS m, round((p_size - 32) * 5 / 9.0::DOUBLE, 6) AS c FROM part")
add("transfer_function", lambda s, d: read(s, d, "part").select("p_partkey", F.round(X.piecewise(F.col("p_size") / 50, [(0.0, 0.0), (0.3, 0.8), (1.0, 0.1)]), 6).alias("alpha")), "SELECT p_partkey, round(CASE WHEN t <= 0 THEN 0 WHEN t <= 0.3 THEN t / 0.3 * 0.8 WHEN t <= 1 THEN 0.8 + (t - 0.3) / 0.7 * -0.7 ELSE 0.1 END, 6) AS alpha FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS t FROM part)")
add("colormap", lambda s, d: read(s, d, "part").select("p_partkey", X.colormap(F.col("p_size") * 1.0, 1, 50, [(0.0, (0, 0, 255)), (1.0, (255, 0, 0))]).alias("c")).select("p_partkey", F.col("c")[0].alias("r"), F.col("c")[1].alias("g"), F.col("c")[2].alias("b")), "SELECT p_partkey, round((p_size - 1) / 49.0::DOUBLE * 255)::INT AS r, 0 AS g, round(255 - (p_size - 1) / 49.0::DOUBLE * 255)::INT AS b FROM part")
add("wave_spectrum", lambda s, d: s.range(1, 60).select("id", F.round(X.jonswap(F.col("id") / 20, 0.9), 6).alias("density")), "SELECT i AS id, round(0.0081 * 9.81 * 9.81 / (w ** 5) * exp(-1.25 * (0.9 / w) ** 4) * 3.3 ** exp(-((w - 0.9) ** 2) / (2 * sg * sg * 0.81)), 6) AS density FROM (SELECT i, i / 20.0::DOUBLE AS w, CASE WHEN i / 20.0 <= 0.9 THEN 0.07::DOUBLE ELSE 0.09 END AS sg FROM range(1, 60) t(i))")
add("lang_generator", lambda s, d: L.collect_generator(read(s, d, "part"), lambda k, n: ((k, i * i) for i in range(n)), "p_partkey long, value long", "p_partkey", "p_size"), "SELECT p_partkey, i * i AS value FROM (SELECT p_partkey, unnest(range(p_size)) AS i FROM part)")
