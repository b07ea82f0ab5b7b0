"""Registered queries of the logic engine, each with the same rows in DuckDB.

The driver's tables are relations with columns by position, and every predicate is a set.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analyses
from .lang.datalog import parse_datalog
from .operators import relational
from .plans.engine import Engine, shared_folder
from .plans.ir import ANY, And, Atom, Compare, Const, LogicError, Program, Rule, Var
from .session import query_all_ql, query_datalog, query_ql
from .sinks import results
from .sources import extract_c, extract_java, extract_js, extract_python  # noqa: F401  register their languages
from .sources.database import Database
from .sources.extract import facts_of, scheme_of, source_roots, split_facts
from .sources.models import add_models, parse_access_path, parse_models

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: Keys of the driver's tables that have one.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"]}

TREE = """
parent(p, c) :- part(c, _, _, _, _, _), c > 0, p = c / 2.
edge(p, c)   :- parent(p, c), p > 0.
"""
ANCESTORS = f"""{TREE}
anc(a, d) :- edge(a, d).
anc(a, d) :- anc(a, m), edge(m, d).
"""
FLAGSHIP = f"""{ANCESTORS}
small(d) :- part(d, _, _, _, s, _), s < 10.
q(a, d)  :- anc(a, d), not small(d).
"""
_E = "e AS (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part WHERE p_partkey // 2 > 0)"
PART = """
class Part extends int {
  Part() { part(this, _, _, _, _, _) }
  string getName() { part(this, result, _, _, _, _) }
  string getBrand() { part(this, _, result, _, _, _) }
  string getType() { part(this, _, _, result, _, _) }
  int getSize() { part(this, _, _, _, result, _) }
}
class BigPart extends Part { BigPart() { this.getSize() > 45 } }
class BigPromo extends BigPart { BigPromo() { this.getType() = "PROMO" } }
"""


@dataclass
class Query:
    language: str
    text: str
    sql: str | None
    output: str = "q"
    columns: tuple = ()
    setup: Callable[[SparkSession, str], Database] | None = None
    #: Instead of a program: what makes the rows.
    make: Callable[[SparkSession, str], DataFrame] | None = None


def d(text: str, sql: str | None, *columns: str) -> Query:
    return Query("datalog", text, sql, columns=columns)


def ql(text: str, sql: str | None) -> Query:
    return Query("ql", text, sql)


QUERIES: dict[str, Query] = {
    "flagship": d(FLAGSHIP, f"WITH RECURSIVE {_E}, t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b AS d FROM t WHERE b NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)"),
    "scan_filter": d("q(pk, sz) :- part(pk, _, _, _, sz, _), sz > 40.", "SELECT DISTINCT p_partkey AS pk, CAST(p_size AS BIGINT) AS sz FROM part WHERE p_size > 40"),
    "const_atom": d('q(ok) :- orders(ok, _, "F", _, _, _).', "SELECT DISTINCT o_orderkey AS ok FROM orders WHERE o_orderstatus = 'F'"),
    "project_dedup": d("q(t) :- part(_, _, _, t, _, _).", "SELECT DISTINCT p_type AS t FROM part"),
    "facts": d("e(1, 2). e(2, 3). q(x, z) :- e(x, y), e(y, z).", "SELECT CAST(1 AS BIGINT) AS x, CAST(3 AS BIGINT) AS z"),
    "equi_join": d("q(n, r) :- nation(_, n, k), region(k, r).", "SELECT DISTINCT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "multiway_join": d("q(c, s) :- customer(c, _, n, _, _), orders(o, c, _, _, _, _), lineitem(o, _, s, _, _, _, _, _, _, _, _), supplier(s, _, n, _).", "SELECT DISTINCT c_custkey AS c, s_suppkey AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey"),
    "cross_theta": d("q(x, y) :- region(a, x), region(b, y), a < b.", "SELECT DISTINCT a.r_name AS x, b.r_name AS y FROM region a, region b WHERE a.r_regionkey < b.r_regionkey"),
    "self_join": d("q(r1, r2) :- conversations(c, t, r1, _), u = t + 1, conversations(c, u, r2, _).", "SELECT DISTINCT a.role AS r1, b.role AS r2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"),
    "repeat_var": d("q(k) :- lineitem(_, k, k, _, _, _, _, _, _, _, _).", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey = l_suppkey"),
    "union_rules": d("q(n) :- customer(_, _, n, b, _), b < 0. q(n) :- supplier(_, _, n, b), b < 0.", "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0"),
    "difference": d("big(p) :- lineitem(_, p, _, _, 50, _, _, _, _, _, _). q(pk) :- part(pk, _, _, _, _, _), not big(pk).", "SELECT p_partkey AS pk FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 50"),
    "intersect": d('q(c) :- orders(_, c, "F", _, _, _), orders(_, c, "P", _, _, _).', "SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"),
    "anti_join": d("q(ok) :- orders(ok, _, _, _, _, _), not lineitem(ok, _, _, _, _, _, _, _, _, _, _).", "SELECT DISTINCT o_orderkey AS ok FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "semi_join": d('q(c) :- customer(c, _, _, _, _), orders(_, c, _, _, _, "1-URGENT").', "SELECT DISTINCT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "arith_int": d("q(k, h, r) :- part(k, _, _, _, _, _), h = k / 2, r = k % 3.", "SELECT DISTINCT p_partkey AS k, p_partkey // 2 AS h, p_partkey % 3 AS r FROM part"),
    "arith_div0": d("q(k, d) :- part(k, _, _, _, s, _), z = s - 10, d = 100 / z.", "SELECT DISTINCT p_partkey AS k, CAST(trunc(100.0 / (p_size - 10)) AS BIGINT) AS d FROM part WHERE p_size <> 10"),
    "arith_float": d("q(k, n, v) :- lineitem(k, _, _, n, qty, price, _, _, _, _, _), qty > 49, v = price * qty.", "SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_extendedprice * l_quantity AS v FROM lineitem WHERE l_quantity > 49"),
    "tc_linear": d(f"{ANCESTORS} q(a, b) :- anc(a, b).", f"WITH RECURSIVE {_E}, t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t"),
    "tc_cyclic": d("e(a, b) :- nation(a, _, _), b = a * 2 % 25. t(a, b) :- e(a, b). t(a, c) :- e(a, b), t(b, c). q(a, b) :- t(a, b).", "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 2) % 25 AS BIGINT) AS b FROM nation), t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t"),
    "tc_nonlinear": d("e(a, b) :- nation(a, _, _), b = a * 2 % 25. t(a, b) :- e(a, b). t(a, c) :- t(a, b), t(b, c). q(a, b) :- t(a, b).", "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 2) % 25 AS BIGINT) AS b FROM nation), t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t"),
    "tc_reflexive": ql("predicate e(int a, int b) { nation(a, _, _) and b = a * 5 % 25 } from int a, int b where e*(a, b) select a, b", "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 5) % 25 AS BIGINT) AS b FROM nation), t(a, b) AS (SELECT a, a FROM e UNION SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t"),
    "reach_from_root": d(f"{TREE} q(b) :- edge(3, b). q(c) :- q(b), edge(b, c).", f"WITH RECURSIVE {_E}, t(b) AS (SELECT b FROM e WHERE a = 3 UNION SELECT e.b FROM t JOIN e ON t.b = e.a) SELECT b FROM t", "b"),
    "mutual_recursion": d(f"{TREE} even(1). odd(c) :- even(p), edge(p, c). even(c) :- odd(p), edge(p, c). q(k) :- even(k).", "WITH RECURSIVE t(k, d) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT p.p_partkey, 1 - t.d FROM t JOIN part p ON p.p_partkey // 2 = t.k AND p.p_partkey > 1) SELECT k FROM t WHERE d = 0"),
    "neg_over_recursion": d(f"{TREE} r(b) :- edge(2, b). r(c) :- r(b), edge(b, c). q(k) :- part(k, _, _, _, _, _), not r(k).", f"WITH RECURSIVE {_E}, t(b) AS (SELECT b FROM e WHERE a = 2 UNION SELECT e.b FROM t JOIN e ON t.b = e.a) SELECT p_partkey AS k FROM part EXCEPT SELECT b FROM t"),
    "agg_count": d('q(c, n) :- customer(c, _, _, _, _), n = count { o : orders(o, c, _, _, _, "1-URGENT") }.', "SELECT c_custkey AS c, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1"),
    "agg_strictcount": d('q(c, n) :- customer(c, _, _, _, _), n = strictcount { o : orders(o, c, _, _, _, "1-URGENT") }.', "SELECT o_custkey AS c, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"),
    "agg_sum": d("q(b, s) :- part(_, _, b, _, _, _), s = sum { z : part(_, _, b, _, z, _) }.", "SELECT p_brand AS b, CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part GROUP BY 1"),
    "agg_strictsum": d('q(n, s) :- nation(n, _, _), s = strictsum { k : customer(k, _, n, _, "BUILDING") }.', "SELECT CAST(c_nationkey AS BIGINT) AS n, CAST(sum(DISTINCT c_custkey) AS BIGINT) AS s FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1"),
    "agg_min_max": d("q(t, lo, hi) :- part(_, _, _, t, _, _), lo = min { z : part(_, _, _, t, z, _) }, hi = max { y : part(_, _, _, t, y, _) }.", "SELECT p_type AS t, CAST(min(p_size) AS BIGINT) AS lo, CAST(max(p_size) AS BIGINT) AS hi FROM part GROUP BY 1"),
    "agg_avg": d("q(t, a) :- part(_, _, _, t, _, _), a = avg { z : part(_, _, _, t, z, _) }.", "SELECT p_type AS t, avg(DISTINCT p_size) AS a FROM part GROUP BY 1"),
    "agg_concat": d('q(n, s) :- customer(_, _, n, _, _), s = concat { m, "," : customer(_, _, n, _, m) }.', "SELECT CAST(c_nationkey AS BIGINT) AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS s FROM customer GROUP BY 1"),
    "agg_unique": d("q(c, s) :- orders(_, c, _, _, _, _), s = unique { t : orders(_, c, t, _, _, _) }.", "SELECT o_custkey AS c, min(o_orderstatus) AS s FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1"),
    "agg_rank": d("q(t, s) :- part(_, _, _, t, _, _), s = rank[2] { z : part(_, _, _, t, z, _) }.", "SELECT t, CAST(s AS BIGINT) AS s FROM (SELECT p_type AS t, p_size AS s, dense_rank() OVER (PARTITION BY p_type ORDER BY p_size) AS r FROM (SELECT DISTINCT p_type, p_size FROM part)) WHERE r = 2"),
    "agg_rank_all": ql("from string t, int i, int s where part(_, _, _, t, _, _) and s = rank[i](int z | part(_, _, _, t, z, _) | z order by z desc) and i <= 3 select t, i, s", "SELECT t, r AS i, CAST(s AS BIGINT) AS s FROM (SELECT p_type AS t, p_size AS s, dense_rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS r FROM (SELECT DISTINCT p_type, p_size FROM part)) WHERE r <= 3"),
    "agg_any": ql("from string r, string n where region(_, r) and n = any(string x | exists(int k | region(k, r) and nation(_, x, k)) | x) select r, n", "SELECT DISTINCT r_name AS r, n_name AS n FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "agg_global": d("q(n) :- n = count { o : orders(o, _, _, _, _, _) }.", "SELECT count(DISTINCT o_orderkey) AS n FROM orders"),
    "agg_nested": ql("from int n where n = max(int c, int k | customer(c, _, _, _, _) and k = count(int o | orders(o, c, _, _, _, _)) | k) select n", "SELECT max(k) AS n FROM (SELECT count(DISTINCT o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"),
    "forall": ql('from int c where customer(c, _, _, _, _) and forall(int o | orders(o, c, _, _, _, "1-URGENT") | orders(o, c, "F", _, _, _)) select c', "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F')"),
    "forex": ql('from int c where customer(c, _, _, _, _) and forex(int o | orders(o, c, _, _, _, "1-URGENT") | orders(o, c, "F", _, _, _)) select c', "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F')"),
    "exists_formula": ql("from int c where customer(c, _, _, _, _) and exists(int o, float p | orders(o, c, _, p, _, _) and p > 300000.0) select c", "SELECT DISTINCT o_custkey AS c FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000.0"),
    "not_exists": ql("from int c where customer(c, _, _, _, _) and not exists(int o | orders(o, c, \"F\", _, _, _)) select c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "disjunction": ql("from int k where exists(string t, int s | part(k, _, _, t, s, _) and (t = \"PROMO\" or s < 3)) select k", "SELECT p_partkey AS k FROM part WHERE p_type = 'PROMO' OR p_size < 3"),
    "implies": ql('from int k, string t, int s where part(k, _, _, t, s, _) and (t = "STANDARD" implies s < 25) select k', "SELECT p_partkey AS k FROM part WHERE NOT p_type = 'STANDARD' OR p_size < 25"),
    "if_then_else": ql("from int k, int s, int label where part(k, _, _, _, s, _) and if s > 25 then label = 100 else label = 0 select k, label", "SELECT p_partkey AS k, CAST(CASE WHEN p_size > 25 THEN 100 ELSE 0 END AS BIGINT) AS label FROM part"),
    "if_exists": ql('from int c, string s where customer(c, _, _, _, _) and (if orders(_, c, "F", _, _, _) then s = "some" else s = "none") select c, s', "SELECT c_custkey AS c, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'some' ELSE 'none' END AS s FROM customer"),
    "in_range": ql("from int k, int s where part(k, _, _, _, s, _) and s in [5 .. 9] select k", "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 5 AND 9"),
    "range_generate": ql("from int r, int x where region(r, _) and x = [1 .. r + 1] select r, x", "SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(unnest(generate_series(1, r_regionkey + 1)) AS BIGINT) AS x FROM region"),
    "set_literal": ql("from int k, int s where part(k, _, _, _, s, _) and s in [1, 7, 49] select k", "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 7, 49)"),
    "str_funcs": ql("from string s where customer(_, _, _, _, s) select s, s.length() as n, s.toLowerCase() as l, s.prefix(3) as p, s.suffix(2) as x, s.charAt(1) as c, s.substring(1, 4) as m, s.replaceAll(\"A\", \"_\") as r", "SELECT DISTINCT c_mktsegment AS s, length(c_mktsegment) AS n, lower(c_mktsegment) AS l, left(c_mktsegment, 3) AS p, substr(c_mktsegment, 3) AS x, substr(c_mktsegment, 2, 1) AS c, substr(c_mktsegment, 2, 3) AS m, replace(c_mktsegment, 'A', '_') AS r FROM customer"),
    "str_regex": ql('from string b where part(_, _, b, _, _, _) and b.regexpMatch("Brand#[0-9]+") select b, b.regexpCapture("Brand#([0-9]+)", 1) as d', "SELECT DISTINCT p_brand AS b, regexp_extract(p_brand, '^Brand#([0-9]+)$', 1) AS d FROM part WHERE regexp_full_match(p_brand, 'Brand#[0-9]+')"),
    "str_like": ql('from string t where part(_, _, _, t, _, _) and t.matches("%AN%") select t', "SELECT DISTINCT p_type AS t FROM part WHERE p_type LIKE '%AN%'"),
    "str_split": ql('from string p where orders(_, _, _, _, _, p) select p, p.splitAt("-") as w', "SELECT DISTINCT o_orderpriority AS p, unnest(string_split(o_orderpriority, '-')) AS w FROM orders"),
    "str_concat": ql('from string n, int k where nation(k, n, _) select "n" + k + ":" + n as s', "SELECT 'n' || n_nationkey || ':' || n_name AS s FROM nation"),
    "str_convert": ql('from string b where part(_, _, b, _, _, _) select b.regexpCapture("Brand#([0-9]+)", 1).toInt() as i, b.regexpFind("[0-9]") as d', "SELECT DISTINCT CAST(regexp_extract(p_brand, '^Brand#([0-9]+)$', 1) AS BIGINT) AS i, unnest(regexp_extract_all(p_brand, '[0-9]')) AS d FROM part"),
    "int_bits": ql("from int s where part(_, _, _, _, s, _) select s, s.bitAnd(6) as a, s.bitOr(8) as o, s.bitXor(5) as x, s.bitShiftLeft(2) as l, s.bitShiftRight(1) as r", "SELECT DISTINCT CAST(p_size AS BIGINT) AS s, CAST(p_size & 6 AS BIGINT) AS a, CAST(p_size | 8 AS BIGINT) AS o, CAST(xor(p_size, 5) AS BIGINT) AS x, CAST(p_size AS BIGINT) << 2 AS l, CAST(p_size AS BIGINT) >> 1 AS r FROM part"),
    "int_math": ql("from int s where part(_, _, _, _, s, _) select s, (s - 25).abs() as a, s.minimum(10) as lo, s.maximum(40) as hi, -s as m", "SELECT DISTINCT CAST(p_size AS BIGINT) AS s, CAST(abs(p_size - 25) AS BIGINT) AS a, CAST(least(p_size, 10) AS BIGINT) AS lo, CAST(greatest(p_size, 40) AS BIGINT) AS hi, CAST(-p_size AS BIGINT) AS m FROM part"),
    "float_math": ql("from int k, float b where supplier(k, _, _, b) select k, b.floor() as f, b.ceil() as c, b.abs().sqrt() as r", "SELECT DISTINCT s_suppkey AS k, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c, sqrt(abs(s_acctbal)) AS r FROM supplier"),
    "to_url": ql('from string n, int k where nation(k, n, _) select toUrl(n, k, 1, k, 9) as u', "SELECT 'file://' || n_name || ':' || n_nationkey || ':1:' || n_nationkey || ':9' AS u FROM nation"),
    "ql_class_member": ql(f"{PART} from BigPart p select p as k, p.getBrand() as b", "SELECT DISTINCT p_partkey AS k, p_brand AS b FROM part WHERE p_size > 45"),
    "ql_union_class": ql("class Cust extends int { Cust() { customer(this, _, _, _, _) } } class Supp extends int { Supp() { supplier(this, _, _, _) } } class Party = Cust or Supp; from Party p select p as k", "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier"),
    "ql_dispatch": ql(f"{PART} from BigPromo p select p.getName() as n", "SELECT DISTINCT p_name AS n FROM part WHERE p_size > 45 AND p_type = 'PROMO'"),
    "ql_override": ql(f'{PART} class Named extends Part {{ string tag() {{ result = "part" }} }} class NamedBig extends Named {{ NamedBig() {{ this.getSize() > 45 }} override string tag() {{ result = "big " + super.tag() }} }} from Named p select p as k, p.tag() as t', "SELECT p_partkey AS k, CASE WHEN p_size > 45 THEN 'big part' ELSE 'part' END AS t FROM part"),
    "ql_instanceof_cast": ql(f"{PART} from Part p where p instanceof BigPart and p.(BigPart).getSize() < 48 select p as k", "SELECT p_partkey AS k FROM part WHERE p_size > 45 AND p_size < 48"),
    "ql_fields": ql("class Sized extends int { int size; Sized() { part(this, _, _, _, size, _) } int twice() { result = size * 2 } } from Sized s where s.twice() > 90 select s as k, s.twice() as t", "SELECT p_partkey AS k, CAST(p_size * 2 AS BIGINT) AS t FROM part WHERE p_size * 2 > 90"),
    "ql_newtype": ql("newtype TPlace = Nation(int n) { nation(n, _, _) } or Region(int r) { region(r, _) } predicate isRegion(TPlace p) { p = Region(_) } from int a, int b where a = count(TPlace p) and b = count(TPlace p | isRegion(p)) select a, b", "SELECT CAST((SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS BIGINT) AS a, CAST((SELECT count(*) FROM region) AS BIGINT) AS b"),
    "ql_member_closure": ql("class Node extends int { Node() { part(this, _, _, _, _, _) and this > 0 } Node getParent() { result = this / 2 } } from Node n where n.getParent+() = 7 select n as k", "WITH RECURSIVE t(k) AS (SELECT p_partkey FROM part WHERE p_partkey // 2 = 7 UNION SELECT p.p_partkey FROM part p JOIN t ON p.p_partkey // 2 = t.k) SELECT k FROM t"),
    "ql_module": ql("module Sizes { predicate huge(int k) { exists(int s | part(k, _, _, _, s, _) and s > 48) } } from int k where Sizes::huge(k) select k", "SELECT p_partkey AS k FROM part WHERE p_size > 48"),
    "ql_bindingset": ql("bindingset[x] predicate nearly(int x, int y) { x - y in [-1 .. 1] } from int k, int s where part(k, _, _, _, s, _) and nearly(s, 20) select k", "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 19 AND 21"),
    "ql_select_order": ql("from string n where nation(_, n, _) select n order by n desc", "SELECT DISTINCT n_name AS n FROM nation ORDER BY n DESC"),
    "ql_recursion": ql("int depth(int k) { k = 1 and result = 0 or part(k, _, _, _, _, _) and k > 1 and result = depth(k / 2) + 1 } from int k select k, depth(k) as d", "WITH RECURSIVE t(k, d) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT p.p_partkey, t.d + 1 FROM t JOIN part p ON p.p_partkey // 2 = t.k AND p.p_partkey > 1) SELECT k, d FROM t"),
}


# Queries over relations that are not the driver's tables: facts of sources, models, a schema with entity types.

C_SOURCE = """
int baz(int x) { return x; }
int bar(int x, int spare) { return baz(x); }
int foo(int n) { int y = n; int z; z = y; return bar(z, 1) + baz(2); }
int main(void) { int (*fp)(int) = foo; char buf[8]; gets(buf); fp(3); return foo(1) + bar(2, 3); }
"""
PYTHON_SOURCE = """
import os
class Dog(Animal):
    def bark(self, times=2):
        return os.path.join("a", times)
def main():
    return Dog().bark(3)
"""
MODELS = """
extensions:
  - addsTo: {pack: p, extensible: summaryModel}
    data:
      - ["zoo.food", "Bowl", true, "pour", "(Bowl,int)", "", "Argument[0]", "Argument[this].Element", "taint", "manual"]
      - ["zoo.food", "Bowl", true, "lift", "()", "", "Argument[this]", "ReturnValue", "value", "manual"]
"""
SCHEME = """
nation(unique int key: @nation, string name: string ref, int region: @region ref);
region(unique int key: @region, string name: string ref);
@place = @nation | @region;
case @nation.region of 0 = @african | 1 = @american;
"""


def _sources(path: str, text: str, language: str) -> Callable[[SparkSession, str], Database]:
    def setup(spark: SparkSession, sf_dir: str) -> Database:
        files = spark.createDataFrame([(path, bytearray(text.encode()))], "path string, content binary")
        facts_of(files, "", (language,)).write.parquet(folder := _folder(spark, "facts"))
        return split_facts(spark, spark.read.parquet(folder), scheme_of((language,)))

    return setup


JAVA_SOURCE = """
package zoo;
class Animal { int age; Animal(int age) { this.age = age; } int older(int by) { int sum = age + by; return sum; } }
class Dog extends Animal { Dog() { super(1); } @Loud void bark(int times) { older(times); new Animal(times); } }
class Cage<A extends Animal> { enum Mood { CALM, WILD } }
"""


def _models(spark: SparkSession, sf_dir: str) -> Database:
    return add_models(Database(spark), parse_models(MODELS))


def _places(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark, SCHEME)
    for name in ("nation", "region"):
        db.add(name, spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
    return db


def _values(names: str, *rows: tuple) -> str:
    cells = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"CAST({x} AS BIGINT)" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {cells}) AS t({names})"


JS_SOURCE = """
import { feed as give, wash } from "./care.js";
export class Dog extends Animal { bark(times = 2) { return wash(this, `${times} times`); } get age() { return 3; } }
const walk = (dog, { far, ...rest }) => { for (const step of far) dog.go(step); };
"""


_JS = _sources("dog.js", JS_SOURCE, "javascript")
_C, _PY, _JAVA = _sources("a.c", C_SOURCE, "c"), _sources("dog.py", PYTHON_SOURCE, "python"), _sources("Dog.java", JAVA_SOURCE, "java")
QUERIES |= {
    "facts_c_functions": Query("datalog", "q(f, p, i) :- functions(g, f, _), params(g, i, p, _).", _values("f, p, i", ("baz", "x", 0), ("bar", "x", 0), ("bar", "spare", 1), ("foo", "n", 0)), setup=_C),
    "facts_c_lines": Query("datalog", "q(n, total, code) :- files(f, n), numlines(f, total, code, _).", _values("n, total, code", ("a.c", 5, 4)), setup=_C),
    "facts_python_calls": Query("ql", "class Call extends @py_expr { Call() { py_exprs(this, 0, _, _) } string name() { exists(int f | py_exprs(f, _, this, 0) and py_expr_names(f, result)) } } from Call c select c.name() as n", _values("n", ("join",), ("Dog",), ("bark",)), setup=_PY),
    "facts_python_scopes": Query("datalog", "q(c, f) :- py_Classes(k, c, _, _), py_Functions(_, f, k, _).", _values("c, f", ("Dog", "bark")), setup=_PY),
    "facts_java_members": Query("datalog", "q(c, m, s) :- methods(x, m, s, _, k, _), classes_or_interfaces(k, c, _, _), not compiler_generated(x, _).", _values("c, m, s", ("Animal", "older", "older(int)"), ("Dog", "bark", "bark(int)")), setup=_JAVA),
    "facts_java_generics": Query("datalog", "q(c, v, t) :- typeVars(x, v, _, k), classes_or_interfaces(k, c, _, _), typeBounds(_, t, _, x).", _values("c, v, t", ("Cage", "A", "Animal")), setup=_JAVA),
    "facts_java_generated": Query("datalog", "q(c, s) :- constrs(k, _, s, _, o, _), isDefConstr(k), classes_or_interfaces(o, c, _, _). q(c, s) :- methods(k, _, s, _, o, _), compiler_generated(k, _), classes_or_interfaces(o, c, _, _).", _values("c, s", ("Cage", "Cage()"), ("Mood", "values()"), ("Mood", "valueOf(String)")), setup=_JAVA),
    "facts_java_annotations": Query("datalog", "q(m, a) :- annotations(_, k, a), methods(k, m, _, _, _, _).", _values("m, a", ("bark", "Loud")), setup=_JAVA),
    "facts_js_calls": Query("datalog", 'q(n) :- exprs(c, 13, _, _), exprs(f, 79, c, 0), literals(n, f). q(n) :- exprs(c, 13, _, _), exprs(m, 14, c, 0), exprs(f, 0, m, 1), literals(n, f).', _values("n", ("wash",), ("go",)), setup=_JS),
    "facts_js_functions": Query("datalog", 'q(c, f, k) :- classes(x, c, _), properties(p, x, _, k), scopes(s, 8), functions(_, f, s), f = "age", k = 1. q(c, f, k) :- classes(x, c, _), properties(_, x, _, k), functions(_, f, _), f = "bark", k = 0.', _values("c, f, k", ("Dog", "age", 1), ("Dog", "bark", 0)), setup=_JS),
    "facts_js_imports": Query("datalog", "q(n, p) :- imports(_, _, n, p).", _values("n, p", ("feed, wash", "./care.js")), setup=_JS),
    "facts_js_variables": Query("datalog", "q(v) :- scopes(s, 1), variables(_, v, s).", _values("v", ("times",), ("dog",), ("far",), ("rest",)), setup=_JS),
    "facts_java_subtypes": Query("datalog", "q(a, b) :- extendsReftype(x, y), classes_or_interfaces(x, a, _, _), classes_or_interfaces(y, b, _, _).", _values("a, b", ("Dog", "Animal")), setup=_JAVA),
    "bind_java_calls": Query("datalog", analyses.JAVA_CALL_BINDING + "q(n, m) :- bound(c, f), namestrings(n, _, c), methods(f, m, _, _, _, _).", _values("n, m", ("older", "older")), setup=_JAVA),
    "bind_java_variables": Query("datalog", analyses.JAVA_VARIABLE_BINDING + "q(n, p) :- bound(e, v), namestrings(n, _, e), paramName(v, p).", _values("n, p", ("age", "age"), ("by", "by"), ("times", "times")), setup=_JAVA),
    "bind_c_calls": Query("datalog", analyses.CALL_BINDING + "q(n, f) :- bound(c, k), site(c, _, v), use(v, _, n), functions(k, f, _).", _values("n, f", ("baz", "baz"), ("bar", "bar"), ("foo", "foo")), setup=_C),
    "analysis_call_graph": Query("datalog", analyses.CALL_GRAPH + "q(a, b) :- depends(f, g), functions(f, a, _), functions(g, b, _).", _values("a, b", ("bar", "baz"), ("foo", "bar"), ("foo", "baz"), ("main", "foo"), ("main", "bar"), ("main", "baz")), setup=_C),
    "analysis_outside_calls": Query("datalog", analyses.CALL_GRAPH + "q(f, t) :- outside(k, t), functions(k, f, _).", _values("f, t", ("main", "gets"), ("main", "fp")), setup=_C),
    "analysis_data_flow": Query("datalog", analyses.DATA_FLOW + "q(f, a, b) :- flow(k, a, b), functions(k, f, _).", _values("f, a, b", ("foo", "n", "y"), ("foo", "y", "z"), ("foo", "n", "z"), ("main", "foo", "fp")), setup=_C),
    "analysis_points_to": Query("datalog", analyses.POINTS_TO + "q(f, v, t) :- points(k, v, g), functions(k, f, _), functions(g, t, _).", _values("f, v, t", ("main", "fp", "foo")), setup=_C),
    "analysis_unused": Query("datalog", analyses.UNUSED_PARAMETERS + "q(f, p) :- unused(k, p), functions(k, f, _).", _values("f, p", ("bar", "spare")), setup=_C),
    "analysis_metrics": Query("datalog", analyses.METRICS + "q(f, n, o) :- parameters(k, n), fan_out(k, o), functions(k, f, _).", _values("f, n, o", ("baz", 1, 0), ("bar", 2, 1), ("foo", 1, 2), ("main", 0, 2)), setup=_C),
    "analysis_dangerous": Query("ql", analyses.DANGEROUS, _values("target, caller", ("gets", "main")), setup=_C),
    "models_summary": Query("ql", 'from string n, string i, string o where summaryModel("zoo.food", "Bowl", true, n, _, i, o, "taint", _) select n, i, o', _values("n, i, o", ("pour", "Argument[0]", "Argument[this].Element")), setup=_models),
    "schema_union": Query("ql", "from int k, @place p where p = k select k", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION SELECT r_regionkey FROM region", setup=_places),
    "schema_case": Query("ql", "class American extends @american { string name() { nation(this, result, _) } } from American a select a.name() as n", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1", setup=_places),
}


# Queries that test one thing each, over the driver's tables.

_K = "SELECT CAST(r_regionkey AS BIGINT) AS k"
QUERIES |= {
    "arity_mismatch": d("q(k) :- region(k, _, _). q(k) :- nation(k, _, 1).", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_regionkey = 1"),
    "head_constants": d('q(k, "small", 3) :- part(k, _, _, _, s, _), s < 3.', "SELECT p_partkey AS k, 'small' AS c1, CAST(3 AS BIGINT) AS c2 FROM part WHERE p_size < 3"),
    "minus_as_sign": d("q(k, z) :- nation(k, _, _), z = k -1.", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey - 1 AS BIGINT) AS z FROM nation"),
    "comments_and_modulo": d("// all of it\nq(k, m) :- nation(k, _, _), /* not\n a comment sign: */ m = k % 4. // end", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey % 4 AS BIGINT) AS m FROM nation"),
    "string_escapes": d('q(n, s) :- region(_, n), s = "\\"\\t".', "SELECT r_name AS n, '\"' || chr(9) AS s FROM region"),
    "constant_first": d("q(k, s) :- part(k, _, _, _, s, _), 48 < s, 50 >= s.", "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size > 48 AND p_size <= 50"),
    "arith_overflow": d("q(k, v) :- region(k, _), v = 9223372036854775805 + k.", f"{_K}, CAST(9223372036854775805::HUGEINT + r_regionkey AS BIGINT) AS v FROM region WHERE r_regionkey <= 2"),
    "arith_negative": d("q(k, h, r) :- nation(k, _, _), x = k - 12, h = x / 5, r = x % 5.", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(trunc((n_nationkey - 12) / 5.0) AS BIGINT) AS h, CAST(n_nationkey - 12 - 5 * trunc((n_nationkey - 12) / 5.0) AS BIGINT) AS r FROM nation"),
    "arith_promotion": d("q(k, v) :- supplier(k, _, _, b), v = b * 2 + k.", "SELECT s_suppkey AS k, s_acctbal * 2 + s_suppkey AS v FROM supplier"),
    "any_none": ql("from int k where region(k, _) and (any() and k > 1 or none() or k = 0 and not unreachable()) select k", f"{_K} FROM region WHERE r_regionkey <> 1"),
    "agg_strictconcat": ql('from string r, string s where region(_, r) and s = strictconcat(string n | exists(int k | region(k, r) and nation(_, n, k)) and n > "J" | n, ";") select r, s', "SELECT r_name AS r, string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS s FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name > 'J' GROUP BY 1"),
    "agg_language_note": ql("language[monotonicAggregates] int nations(int r) { region(r, _) and result = count(int n | nation(n, _, r)) } from int k select k, nations(k) as n", f"{_K}, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "pragma_wrapper": ql("from int k where nation(k, _, _) and k = pragma[only_bind_out](7) + pragma[only_bind_into](4) select k", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey = 11"),
    "precedence": ql("from int k, int s where part(k, _, _, _, s, _) and (not s = 3 and s < 5 or s = 10 implies s + 2 * 3 - -1 = 9) select k", "SELECT p_partkey AS k FROM part WHERE NOT ((NOT p_size = 3 AND p_size < 5) OR p_size = 10) OR p_size + 2 * 3 + 1 = 9"),
    "str_index": ql('from string n, int i where nation(_, n, _) and i = n.indexOf("A") select n, i', "SELECT DISTINCT n_name AS n, CAST(i AS BIGINT) AS i FROM (SELECT n_name, unnest(generate_series(0, length(n_name) - 1)) AS i FROM nation) WHERE substring(n_name, CAST(i AS INT) + 1, 1) = 'A'"),
    "str_case_trim": ql('from string n where nation(_, n, _) select n.toLowerCase().toUpperCase() as u, ("  " + n + "\\t").trim() as t, n.toLowerCase().replaceAll("a", "").length() as l', "SELECT DISTINCT upper(lower(n_name)) AS u, trim(n_name) AS t, CAST(length(replace(lower(n_name), 'a', '')) AS BIGINT) AS l FROM nation"),
    "str_regexp_replace": ql('from string b where part(_, _, b, _, _, _) select b, b.regexpReplaceAll("[0-9]+", "<$0>") as r', "SELECT DISTINCT p_brand AS b, regexp_replace(p_brand, '([0-9]+)', '<\\1>', 'g') AS r FROM part"),
    "str_split_at": ql('from string p where orders(_, _, _, _, _, p) select p, p.splitAt("-", 1) as w', "SELECT DISTINCT o_orderpriority AS p, split_part(o_orderpriority, '-', 2) AS w FROM orders WHERE contains(o_orderpriority, '-')"),
    "str_number": ql('from string b where part(_, _, b, _, _, _) select b, (b.suffix(6) + ".5").toFloat() as f, b.suffix(6).toInt().toString() as s', "SELECT DISTINCT p_brand AS b, CAST(substring(p_brand, 7) || '.5' AS DOUBLE) AS f, CAST(CAST(substring(p_brand, 7) AS BIGINT) AS VARCHAR) AS s FROM part"),
    "str_is_case": ql('from string n, int c where exists(string x | nation(_, x, _) | n = x or n = x.toLowerCase()) and (n.isLowercase() and c = 0 or n.isUppercase() and c = 1) select n, c', "SELECT n_name AS n, CAST(1 AS BIGINT) AS c FROM nation UNION SELECT lower(n_name), 0 FROM nation"),
    "int_more_bits": ql("from int k where nation(k, _, _) select k, k.bitNot() as n, (-k).bitShiftRightSigned(1) as r, (-1).bitShiftRight(60) as u, k.toFloat() as f", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(-n_nationkey - 1 AS BIGINT) AS n, CAST(floor(-n_nationkey / 2.0) AS BIGINT) AS r, CAST(15 AS BIGINT) AS u, CAST(n_nationkey AS DOUBLE) AS f FROM nation"),
    "float_more_math": ql("from int k, float b where supplier(k, _, _, b) select k, b.abs().log().floor() as l, b.minimum(100.0) as lo, b.maximum(100.0) as hi", "SELECT s_suppkey AS k, CAST(floor(ln(abs(s_acctbal))) AS BIGINT) AS l, least(s_acctbal, 100.0::DOUBLE) AS lo, greatest(s_acctbal, 100.0::DOUBLE) AS hi FROM supplier WHERE s_acctbal <> 0"),
    "boolean_functions": ql("from int k, boolean a where region(k, _) and (if k > 2 then a = true else a = false) select k, a.booleanNot() as n, a.booleanAnd(true) as d, a.booleanOr(true) as o, a.booleanXor(true) as x, a.toString() as s", f"{_K}, r_regionkey <= 2 AS n, r_regionkey > 2 AS d, true AS o, r_regionkey <= 2 AS x, CASE WHEN r_regionkey > 2 THEN 'true' ELSE 'false' END AS s FROM region"),
    "element_functions": ql("from int k where region(k, _) select k, underlyingElement(k) as u, mkElement(k) as m, unresolveElement(k) as e", f"{_K}, CAST(r_regionkey AS BIGINT) AS u, CAST(r_regionkey AS BIGINT) AS m, CAST(r_regionkey AS BIGINT) AS e FROM region"),
    "to_url_relation": ql("from string n, int k, string u where nation(k, n, _) and toUrl(n, k, 1, k, 9, u) select u", "SELECT 'file://' || n_name || ':' || n_nationkey || ':1:' || n_nationkey || ':9' AS u FROM nation"),
    "ql_external": ql("external predicate excluded(int k); abstract class Place extends int { Place() { region(this, _) } abstract string name(); } class Any extends Place { override string name() { region(this, result) } } from Place p where not excluded(p) select p as k, p.name() as n", f"{_K}, r_name AS n FROM region"),
    "ql_aliases": ql("module M { class R extends int { R() { region(this, _) } } predicate low(int k) { region(k, _) and k < 3 } } module N = M; class S = N::R; predicate few = N::low/1; from S s where few(s) select s as k", f"{_K} FROM region WHERE r_regionkey < 3"),
    "ql_select_only": ql('select 1 as a, "x" as b, 2.5 as c', "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b, 2.5::DOUBLE AS c"),
    "ql_module_parameters": ql("signature class Key; signature predicate link(int a, int b); module Graph<Key K, link/2 step> { predicate twice(K a, K c) { exists(K b | step(a, b) and step(b, c)) } } class N extends int { N() { nation(this, _, _) } } predicate next(int a, int b) { nation(a, _, _) and b = a * 3 % 25 } from int a, int b where Graph<N, next/2>::twice(a, b) select a, b", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey * 9 % 25 AS BIGINT) AS b FROM nation"),
    "ql_module_signature": ql("signature module Sized { class T; int size(T t); default int limit() { result = 48 } } module Parts implements Sized { class T extends int { T() { part(this, _, _, _, _, _) } } int size(T t) { part(t, _, _, _, result, _) } } module Few implements Sized { class T = Parts::T; int size(T t) { result = Parts::size(t) } int limit() { result = 49 } } module Above<Sized S> { predicate big(S::T t) { S::size(t) > S::limit() } } from int k, int n where Above<Parts>::big(k) and n = 48 or Above<Few>::big(k) and n = 49 select k, n", "SELECT p_partkey AS k, CAST(48 AS BIGINT) AS n FROM part WHERE p_size > 48 UNION SELECT p_partkey, 49 FROM part WHERE p_size > 49"),
}


# Reading and writing: rows that went through a file or a text and back.

_NATIONS = 'from int k, string n, int r where nation(k, n, r) select k, n, r'
_NATIONS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation"
_PROBLEM = '/** @name Far nations\n * @kind problem\n * @id x/far\n * @problem.severity error */ from string n, int k where nation(k, n, 1) select toUrl(n, k + 1, 1, k + 2, 9) as at, "in " + n as what'


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_ql(database(spark, sf_dir, ["nation"]), _NATIONS)


def _saved_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    database(spark, sf_dir, ["nation", "region"]).save(folder := _folder(spark, "database"))
    return query_ql(Database.load(spark, folder), "from int k, string n, string r where exists(int g | nation(k, n, g) and region(g, r)) select k, n, r")


def _through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = _nations(spark, sf_dir).withColumn("n", F.concat("n", F.lit(', "quoted"')))
    results.write_csv(odd, folder := _folder(spark, "csv"))
    return spark.read.csv(folder, header=True, quote='"', escape='"', schema=odd.schema)


def _through_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    results.write_parquet(_nations(spark, sf_dir), folder := _folder(spark, "result"))
    return results.read_result(spark, folder)


def _through_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = json.loads(results.to_json(_nations(spark, sf_dir), results.parse_metadata(_PROBLEM)))
    kinds = {"int": "bigint"}
    return spark.createDataFrame([tuple(r) for r in told["rows"]], ", ".join(f"{c['name']} {kinds.get(c['type'], c['type'])}" for c in told["columns"]))


def _through_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query_ql(database(spark, sf_dir, ["nation"]), _PROBLEM)
    run = json.loads(results.to_sarif(found, results.parse_metadata(_PROBLEM)))["runs"][0]
    place = lambda r: r["locations"][0]["physicalLocation"]
    rows = [(r["ruleId"], r["level"], r["message"]["text"], place(r)["artifactLocation"]["uri"], place(r)["region"]["startLine"]) for r in run["results"]]
    return spark.createDataFrame(rows, "rule string, level string, message string, uri string, line long")


def _through_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = results.to_table(_nations(spark, sf_dir)).split("\n")
    head, *rows = ([c.strip() for c in x.strip("|").split("|")] for x in lines if not x.startswith("|-"))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in head))


def _dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every predicate of a program, with its number of rows."""
    found = Engine(database(spark, sf_dir, ["nation"])).run(parse_datalog("low(k) :- nation(k, _, 0). pair(a, b) :- low(a), low(b), a < b."))
    parts = [df.agg(F.lit(name).alias("pred"), F.count("*").alias("n")) for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = results.parse_metadata("/**\n * @name Wide\n *   name\n * @kind path-problem\n * @id a/b\n * @problem.severity warning\n * @security-severity 7.5\n * @tags one\n *       two\n */ select 1")
    return spark.createDataFrame([("name", m.name), ("kind", m.kind), ("id", m.id), ("severity", m.severity), ("security", m.security_severity), ("tags", "+".join(m.tags))], "key string, value string")


def _selects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results of a file: two selects and a query predicate."""
    text = "query predicate low(int k) { nation(k, _, 0) } from int k where nation(k, _, 1) select k from int k, string n where region(k, n) select k, n"
    parts = [df.agg(F.count("*").alias("n"), F.lit(len(df.columns)).cast("long").alias("columns")) for df in query_all_ql(database(spark, sf_dir, ["nation", "region"]), text).values()]
    return reduce(DataFrame.unionByName, parts)


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = {"places.Nation": "class Nation extends int { Nation() { nation(this, _, _) } string name() { nation(this, result, _) } }", "places.all": "import places.Nation"}
    return query_ql(database(spark, sf_dir, ["nation"]), "import places.all from Nation n where n.name() > \"R\" select n as k, n.name() as n", library)


def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.rename(spark.read.parquet(f"{sf_dir.rstrip('/')}/region.parquet"), {"r_regionkey": "k", "r_name": "n"})


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of rules made in Python, without a text."""
    x, y, z = map(Var, "xyz")
    far = And((Atom("nation", (x, ANY, y)), Atom("region", (y, z)), Compare(">", y, Const(2))))
    return query_datalog(database(spark, sf_dir, ["nation", "region"]), Program([Rule("far", (x, z), far)]), "far")


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of programs that are not well formed."""
    db, said = database(spark, sf_dir, ["nation"]), []
    for name, run_it in {
        "syntax": lambda: parse_datalog("p(1).\nq(x) :- , ."), "unbound": lambda: query_datalog(db, "q(x, y) :- nation(x, _, _), y > 3.", "q"), "cycle": lambda: query_datalog(db, "p(x) :- nation(x, _, _), not q(x). q(x) :- nation(x, _, _), not p(x).", "q"),
        "name": lambda: query_ql(db, "from int x where nowhere(x) select x"), "arity": lambda: query_ql(db, "from int x where nation(x) select x"),
    }.items():
        try:
            run_it()
        except LogicError as problem:
            place = re.search(r"(\d+):(\d+)", str(problem))
            said.append((name, type(problem).__name__, place[0] if place else ""))
    return spark.createDataFrame(said, "name string, kind string, place string")


def _access_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["Argument[0..2].Field[p.Bowl.rim]", "Argument[this].Element", "ReturnValue.MapValue.ArrayElement"]
    rows = [(t, p.root, len(p.steps), p.steps[-1].kind) for t in paths for p in [parse_access_path(t)]]
    return spark.createDataFrame(rows, "path string, root string, steps long, last string")


def _model_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = parse_models(MODELS)
    both = m.merge(parse_models(MODELS.replace("Bowl", "Cup")))
    return spark.createDataFrame([("taint", len(both.by_kind("summaryModel", "taint"))), ("pour", len(both.by_callable("summaryModel", "zoo.food", "Cup", "pour"))), ("none", len(m.by_callable("summaryModel", "zoo.food", "Cup", "pour")))], "what string, n long")


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source folders of a build of two modules; builds are looked for on the driver's disk."""
    with tempfile.TemporaryDirectory() as top:
        for folder in ("a/src/main/java", "b/own"):
            (Path(top) / folder).mkdir(parents=True)
        (Path(top) / "a/pom.xml").write_text("<project/>")
        (Path(top) / "b/build.gradle").write_text('sourceSets { main { java { srcDirs = ["own"] } } }')
        return spark.createDataFrame([(str(Path(p).relative_to(top)),) for p in source_roots(top)], "root string")


def made(make: Callable[[SparkSession, str], DataFrame], sql: str) -> Query:
    return Query("", "", sql, make=make)


QUERIES |= {
    "io_database": made(_saved_database, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "io_csv": made(_through_csv, _NATIONS_SQL.replace("n_name AS", "n_name || ', \"quoted\"' AS")),
    "io_result": made(_through_parquet, _NATIONS_SQL),
    "io_json": made(_through_json, _NATIONS_SQL),
    "io_sarif": made(_through_sarif, "SELECT 'x/far' AS rule, 'error' AS level, 'in ' || n_name AS message, n_name AS uri, CAST(n_nationkey + 1 AS BIGINT) AS line FROM nation WHERE n_regionkey = 1"),
    "io_table": made(_through_table, "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS n, CAST(n_regionkey AS VARCHAR) AS r FROM nation"),
    "io_dump": made(_dumped, "SELECT 'low' AS pred, count(*) AS n FROM nation WHERE n_regionkey = 0 UNION SELECT 'pair', count(*) FROM nation a, nation b WHERE a.n_regionkey = 0 AND b.n_regionkey = 0 AND a.n_nationkey < b.n_nationkey"),
    "io_source_roots": made(_roots, "SELECT * FROM (VALUES ('a/src/main/java'), ('b/own')) AS t(root)"),
    "io_selects": made(_selects, "SELECT count(*) AS n, CAST(1 AS BIGINT) AS columns FROM nation WHERE n_regionkey = 0 UNION ALL SELECT count(*), 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT count(*), 2 FROM region"),
    "ql_imports": made(_imported, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation WHERE n_name > 'R'"),
    "rename": made(_renamed, "SELECT r_regionkey AS k, r_name AS n FROM region"),
    "built_rules": made(_built, "SELECT CAST(n_nationkey AS BIGINT) AS x, r_name AS z FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey > 2"),
    "query_metadata": made(_metadata, "SELECT * FROM (VALUES ('name', 'Wide name'), ('kind', 'path-problem'), ('id', 'a/b'), ('severity', 'warning'), ('security', '7.5'), ('tags', 'one+two')) AS t(key, value)"),
    "program_errors": made(_problems, "SELECT * FROM (VALUES ('syntax', 'SyntaxProblem', '2:9'), ('unbound', 'UnboundVariable', ''), ('cycle', 'StratificationError', ''), ('name', 'QLError', '1:18'), ('arity', 'QLError', '1:18')) AS t(name, kind, place)"),
    "access_paths": made(_access_paths, "SELECT * FROM (VALUES ('Argument[0..2].Field[p.Bowl.rim]', 'Argument', CAST(1 AS BIGINT), 'Field'), ('Argument[this].Element', 'Argument', 1, 'Element'), ('ReturnValue.MapValue.ArrayElement', 'ReturnValue', 2, 'ArrayElement')) AS t(path, root, steps, last)"),
    "model_lookups": made(_model_lookups, "SELECT * FROM (VALUES ('taint', CAST(2 AS BIGINT)), ('pour', 1), ('none', 0)) AS t(what, n)"),
}


def database(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> Database:
    db = Database(spark)
    for name in names or TABLES:
        db.add(name, spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), key=KEYS.get(name))
    return db


def used_tables(text: str) -> list[str]:
    """Tables whose name occurs in a program."""
    words = set(re.findall(r"[a-z]+", text))
    return [t for t in TABLES if t in words]


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    q = QUERIES[name]
    if q.make:
        return q.make(spark, sf_dir)
    db = q.setup(spark, sf_dir) if q.setup else database(spark, sf_dir, used_tables(q.text) or ["region"])
    if q.language == "datalog":
        return query_datalog(db, q.text, q.output, list(q.columns) or None)
    return query_ql(db, q.text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: run(spark, sf_dir, name)) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
