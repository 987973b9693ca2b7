"""DuckDB SQL for the annotation queries, written apart from the Spark form."""

from __future__ import annotations

D = r"d AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)"
B = r"b AS (SELECT item_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM benchmark)"
FRAG = "fr AS (SELECT doc_id, f AS frag, substr(s, f * 200 + 1, 200) AS s FROM (SELECT doc_id, s, unnest(range(greatest(CAST(ceil(length(s) / 200.0) AS BIGINT), 1))) AS f FROM d))"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def km(s: str, k: int) -> str:
    return f"unnest(list_transform(range(1, length({s}) - {k} + 2), lambda i: substr({s}, i, {k})))"


def idx(k: int, name: str = "ix") -> str:
    return f"{name} AS (SELECT DISTINCT item_id, {km('s', k)} AS kmer FROM b)"


def hits(src: str, ids: str, k: int = 12, name: str = "h", ix: str = "ix") -> str:
    """Distinct (ids, canonical k-mer, item) of either strand."""
    return (
        f"{name}p AS (SELECT DISTINCT {ids}, least(m, {rc('m')}) AS a FROM (SELECT {ids}, {km('s', k)} AS m FROM {src})), "
        f"{name} AS (SELECT DISTINCT {ids}, a, item_id FROM (SELECT {ids}, a, item_id FROM {name}p JOIN {ix} ON kmer = a UNION ALL SELECT {ids}, a, item_id FROM {name}p JOIN {ix} ON kmer = {rc('a')}))"
    )


FH = f"{D}, {B}, {FRAG}, {idx(12)}, {hits('fr', 'doc_id, frag')}"
UNIT = f"{FH}, u AS (SELECT doc_id, frag, item_id, count(*) AS n FROM h GROUP BY ALL)"
BEST = f"{UNIT}, sc AS (SELECT doc_id, item_id, max(n) AS score FROM u GROUP BY ALL)"
ANN = f"{BEST}, an AS (SELECT * FROM sc WHERE score >= 5)"
WHOLE = f"{D}, {B}, {idx(12)}, {hits('d', 'doc_id')}"
LIN = "lin AS (SELECT CAST(n_nationkey AS BIGINT) AS tid, CAST(n_nationkey AS BIGINT) + 1 AS l0, CAST(n_regionkey AS BIGINT) + 1 AS l1, CAST(1 AS BIGINT) AS l2 FROM nation)"
FRAC = "f AS (SELECT doc_id, item_id, sum(w) AS score FROM (SELECT doc_id, item_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id, a) AS w FROM h) GROUP BY ALL)"


def match(a: str, b: str, none: int, levels: int = 3) -> str:
    return "CASE " + " ".join(f"WHEN {a}.l{k} = {b}.l{k} AND {a}.l{k} <> 0 THEN {k}" for k in range(levels)) + f" ELSE {none} END"


CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"


def prot(s: str) -> str:
    """Translation of codons from the start of s."""
    digit = lambda i, j: f"(strpos('ACGT', substr({s}, 3 * {i} + {j}, 1)) - 1)"
    return f"coalesce(array_to_string(list_transform(range(length({s}) // 3), lambda i: substr('{CODE}', CAST(16 * {digit('i', 1)} + 4 * {digit('i', 2)} + {digit('i', 3)} + 1 AS BIGINT), 1)), ''), '')"


def frames(src: str, owner: str) -> str:
    parts = [f"SELECT {owner}, CAST({f} AS BIGINT) AS frame, substr({'s' if f < 3 else rc('s')}, {f % 3 + 1}) AS t FROM {src}" for f in range(6)]
    return f"ff AS ({' UNION ALL '.join(parts)}), fp AS (SELECT {owner}, frame, {prot('t')} AS protein FROM ff)"


def packed(legacy: bool) -> str:
    v = lambda j: f"(strpos('ACTG', substr(c, {j}, 1)) - 1)"
    fwd = f"CASE length(c) WHEN 3 THEN 16 * {v(1)} + 4 * {v(2)} + {v(3)} WHEN 2 THEN 4 * {v(1)} + {v(2)} ELSE {v(1)} END"
    rev = f"CASE length(c) WHEN 3 THEN 16 * {v(3)} + 4 * {v(2)} + {v(1)} WHEN 2 THEN 4 * {v(2)} + {v(1)} ELSE {v(1)} END"
    symbol = "CASE WHEN x < y THEN x ELSE y + 1 END" if legacy else "least(x, y) + 1"
    return f"WITH {B}, c AS (SELECT item_id, i AS pos, substr(s, 3 * i + 1, 3) AS c FROM (SELECT item_id, s, unnest(range(CAST(ceil(length(s) / 3.0) AS BIGINT))) AS i FROM b)), xy AS (SELECT item_id, pos, {fwd} AS x, {rev} AS y FROM c) SELECT item_id, pos, CAST({symbol} AS BIGINT) AS symbol FROM xy"


TREE = "te AS (SELECT DISTINCT CAST(0 AS BIGINT) AS level, r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT 1, n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"
CUST = "cu AS (SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(n_nationkey AS BIGINT) AS n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"
BYSRC = lambda how: f"{BEST}, bs AS (SELECT source, item_id, CAST({how}(score) AS BIGINT) AS score FROM sc JOIN documents USING (doc_id) GROUP BY ALL)"
UNION = f"{BEST}, {hits('d', 'doc_id', name='h2')}, f AS (SELECT doc_id, item_id, sum(w) AS score FROM (SELECT doc_id, item_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id, a) AS w FROM h2) GROUP BY ALL), su AS (SELECT doc_id, item_id % 25 AS tid, round(sum(score), 6) AS score FROM (SELECT doc_id, item_id, CAST(score AS DOUBLE) AS score FROM sc UNION ALL SELECT * FROM f) WHERE item_id % 25 > 0 GROUP BY ALL)"
SPECIES = f"{UNION}, sp AS (SELECT doc_id, arg_max(tid, (score, -tid)) AS tid, max(score) AS score FROM su GROUP BY doc_id)"
PE = "m AS (SELECT event_id // 2 AS pair, max(user_id) FILTER (event_id % 2 = 0) AS x, max(user_id) FILTER (event_id % 2 = 1) AS y FROM events GROUP BY 1), pe AS (SELECT least(x, y) AS u, greatest(x, y) AS v, count(*) AS w FROM m WHERE x <> y GROUP BY ALL)"


def reach(edges: str, name: str) -> str:
    """name: (node, comp) over the edges (u, v)."""
    return f"{name}e AS (SELECT u, v FROM {edges} UNION SELECT v, u FROM {edges}), {name}r AS (SELECT u AS node, u AS to_ FROM {name}e UNION SELECT r.node, e.v FROM {name}r r JOIN {name}e e ON r.to_ = e.u), {name} AS (SELECT node, min(to_) AS comp FROM {name}r GROUP BY node)"


def merge_pass(k: int, ratio: str, guarded: bool, before: str) -> str:
    guard = "AND (cu.size <= 140 OR cv.size <= 140)" if guarded else ""
    return (
        f"sz{k} AS (SELECT comp, sum(length) AS size FROM {before} JOIN len USING (node) GROUP BY comp), cs{k} AS (SELECT node, comp, size FROM {before} JOIN sz{k} USING (comp)), "
        f"ed{k} AS (SELECT DISTINCT cu.comp AS u, cv.comp AS v FROM ra JOIN cs{k} cu ON ra.u = cu.node JOIN cs{k} cv ON ra.v = cv.node WHERE ratio >= {ratio} {guard} AND cu.comp <> cv.comp), "
        f"{reach(f'ed{k}', f'co{k}')}, pa{k} AS (SELECT b.node, coalesce(c.comp, b.comp) AS comp FROM {before} b LEFT JOIN co{k} c ON b.comp = c.node)"
    )


SUF = f"{B}, su AS (SELECT item_id, p AS pos, substr(s, p + 1) AS suffix, s FROM (SELECT item_id, s, unnest(range(length(s) + 1)) AS p FROM b)), sa AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY suffix) - 1 AS rank FROM su)"
LCP = f"{SUF}, pv AS (SELECT item_id, pos, suffix, lag(suffix) OVER (PARTITION BY item_id ORDER BY suffix) AS prev FROM sa), lc AS (SELECT item_id, pos, len(list_filter(range(1, least(length(suffix), length(prev)) + 1), lambda i: left(suffix, i) = left(prev, i))) AS depth FROM pv WHERE prev IS NOT NULL), de AS (SELECT item_id, pos + depth - 1 AS end_pos, max(depth) AS depth FROM lc WHERE depth > 0 GROUP BY ALL)"
FLAG = f"{UNIT}, fl AS (SELECT fr.doc_id, CAST(fr.frag AS BIGINT) AS frag, CAST(coalesce(max(n) >= 5, false) AS BIGINT) AS flag FROM fr LEFT JOIN u ON fr.doc_id = u.doc_id AND fr.frag = u.frag GROUP BY ALL)"
MAP = f"{ANN}, bm AS (SELECT doc_id, arg_max(item_id, (score, -item_id)) AS item_id FROM an GROUP BY doc_id), rm AS (SELECT doc_id, source, coalesce(item_id, -1) AS item_id FROM documents LEFT JOIN bm USING (doc_id))"
COMP = "co AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), cp AS (SELECT *, n / sum(n) OVER (PARTITION BY l_suppkey) AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC) AS r FROM co)"
DL = "dl AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)"

GENES = f"{B}, rg AS (SELECT DISTINCT l_orderkey AS seqid, l_linenumber * 9 - 12 AS st, l_linenumber * 9 - 12 + CAST(l_quantity AS BIGINT) AS en FROM lineitem), ge AS (SELECT seqid, CAST(st AS BIGINT) AS st, CAST(en AS BIGINT) AS en, substr(s, st, en - st + 1) AS gene FROM rg JOIN b ON item_id = seqid WHERE st >= 1 AND en > st AND en <= length(s))"
STRANDS = f"{D}, {B}, rd AS (SELECT item_id AS read_id, CASE WHEN item_id % 2 = 1 THEN {rc('s')} ELSE s END AS s FROM b), st AS (SELECT read_id, CAST(0 AS BIGINT) AS strand, s FROM rd UNION ALL SELECT read_id, 1, {rc('s')} FROM rd), r AS (SELECT read_id, strand, i, substr(s, i, 12) AS m FROM (SELECT *, unnest(range(1, length(s) - 10)) AS i FROM st)), c AS (SELECT doc_id, i, substr(s, i, 12) AS m FROM (SELECT doc_id, s, unnest(range(1, length(s) - 10)) AS i FROM d)), p AS (SELECT DISTINCT read_id, strand, doc_id, c.i - r.i AS pos FROM r JOIN c USING (m) WHERE c.i >= r.i), f AS (SELECT read_id, strand, doc_id, pos, st.s AS rs, substr(d.s, pos + 1, length(st.s)) AS cs FROM p JOIN st USING (read_id, strand) JOIN d USING (doc_id) WHERE pos + length(st.s) <= length(d.s)), q AS (SELECT read_id, strand, doc_id AS ctg_id, pos, length(rs) AS n, len(list_filter(range(1, length(rs) + 1), lambda i: rs[i] = cs[i])) AS score FROM f), w AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, ctg_id, pos, strand) AS k FROM q WHERE score >= 0.95::DOUBLE * n)"
_P = "(1 + 0.01::DOUBLE * 0.01::DOUBLE - 5 * 0.01::DOUBLE / 3)"
CONTIG_READ = f"{STRANDS}, gr AS (SELECT read_id FROM w WHERE k = 1 AND score >= 15), s2 AS (SELECT item_id AS read_id, 0 AS strand, s FROM b WHERE item_id IN (SELECT read_id FROM gr) UNION ALL SELECT item_id, 1, {rc('s')} FROM b WHERE item_id IN (SELECT read_id FROM gr)), r2 AS (SELECT read_id, strand, i, substr(s, i, 12) AS m FROM (SELECT *, unnest(range(1, length(s) - 10)) AS i FROM s2)), p2 AS (SELECT DISTINCT doc_id, read_id, strand, c.i - r2.i AS d FROM c JOIN r2 USING (m)), f2 AS (SELECT doc_id, read_id, CASE WHEN d >= 0 THEN substr(dd.s, d + 1) ELSE substr(s2.s, 1 - d) END AS x, CASE WHEN d >= 0 THEN s2.s ELSE dd.s END AS y FROM p2 JOIN s2 USING (read_id, strand) JOIN d dd USING (doc_id) WHERE (length(dd.s) < 8000 AND length(s2.s) < 8000) OR length(dd.s) < 1000 OR length(s2.s) < 1000), o2 AS (SELECT doc_id, read_id, least(length(x), length(y)) AS n, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[i] = y[i])) AS g FROM f2), ce AS (SELECT DISTINCT doc_id AS ctg_id, read_id FROM o2 WHERE g >= 14 AND g - 14 >= CAST(trunc((n - 14) * {_P} - sqrt({_P} * (1 - {_P}) * (n - 14)) * 1.65::DOUBLE) AS BIGINT))"

ORACLES: dict[str, str] = {
    "annotate_contigs": f"WITH {ANN} SELECT doc_id, item_id, score FROM an",
    "revcomp": f"WITH {D} SELECT doc_id, {rc('s')} AS rc FROM d",
    "fragments": f"WITH {D}, {FRAG} SELECT doc_id, CAST(frag AS BIGINT) AS frag, length(s) AS size FROM fr",
    "kmers_canonical": f"WITH {D} SELECT DISTINCT doc_id, least(m, {rc('m')}) AS a, greatest(m, {rc('m')}) AS b FROM (SELECT doc_id, {km('s', 8)} AS m FROM d)",
    "translate_six_frames": f"WITH {B}, {frames('b', 'item_id')} SELECT item_id, frame, protein FROM fp",
    "codon_pack": packed(False),
    "codon_pack_legacy": packed(True),
    "char_code_bwt": "SELECT item_id, i AS pos, CAST(CASE substr(t, i + 1, 1) WHEN 'A' THEN 4 WHEN 'C' THEN 5 WHEN 'G' THEN 6 WHEN 'T' THEN 7 WHEN 'N' THEN 3 ELSE 2 END AS BIGINT) AS code FROM (SELECT item_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t, unnest(range(length(text))) AS i FROM benchmark)",
    "base_code_counts": "SELECT doc_id, length(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[ACGT]', '', 'g')) AS other, length(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', '', 'g')) AS acgt FROM documents",
    "split_lineage": "SELECT p_partkey, CAST(i - 1 AS BIGINT) AS level, t[i] AS name, CASE WHEN i > 1 THEN t[i] || (i - 1) ELSE t[i] END AS uniq FROM (SELECT p_partkey, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ') AS t FROM part))",
    "binomial_bound": "SELECT DISTINCT l_quantity AS q, CAST(trunc(l_quantity * (1 + 0.01::DOUBLE * 0.01::DOUBLE - 5 * 0.01::DOUBLE / 3) - sqrt((1 + 0.01::DOUBLE * 0.01::DOUBLE - 5 * 0.01::DOUBLE / 3) * (1 - (1 + 0.01::DOUBLE * 0.01::DOUBLE - 5 * 0.01::DOUBLE / 3)) * l_quantity) * 1.65::DOUBLE) AS BIGINT) AS bound FROM lineitem",
    "cluster_size_estimate": "SELECT lang, CAST(sum(n) AS BIGINT) AS total, CAST(least(greatest(sum(n) // 300, 2), 200) AS BIGINT) AS clusters FROM (SELECT lang, length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) AS n FROM documents) GROUP BY lang",
    "substring_id": "SELECT c_custkey, split_part(c_name, '#', 1) AS prefix, CAST(split_part(c_name, '#', 2) AS BIGINT) AS number FROM customer",
    "packed_ids": "SELECT item_id, (item_id // 4) * 65536 + item_id % 4 AS sid, item_id // 4 AS genome, item_id % 4 AS gene FROM benchmark",
    "kmer_hits_unit": f"WITH {UNIT} SELECT doc_id, CAST(frag AS BIGINT) AS frag, item_id, n FROM u",
    "kmer_hits_fractional": f"WITH {WHOLE}, {FRAC} SELECT doc_id, item_id, round(score, 6) AS score FROM f",
    "kmer_hits_scoped": f"WITH {D}, {B}, {idx(12, 'i0')}, ix AS (SELECT * FROM i0 WHERE (item_id % 25) % 5 = 0), {hits('d', 'doc_id')}, {FRAC} SELECT doc_id, item_id, round(score, 6) AS score FROM f",
    "kmer_hits_multi_k": f"WITH {D}, {B}, {idx(8, 'i8')}, {idx(12, 'i12')}, {hits('d', 'doc_id', 8, 'ha', 'i8')}, {hits('d', 'doc_id', 12, 'hb', 'i12')}, w AS (SELECT doc_id, item_id, 8 AS k, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id, a) AS w FROM ha UNION ALL SELECT doc_id, item_id, 12, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id, a) FROM hb) SELECT doc_id, item_id, CAST(k AS BIGINT) AS k, round(sum(w), 6) AS score FROM w GROUP BY doc_id, item_id, k",
    "fragment_flags": f"WITH {FLAG} SELECT * FROM fl",
    "frag_bitstring": f"WITH {FLAG} SELECT doc_id, string_agg(CAST(flag AS VARCHAR), '' ORDER BY frag) AS bits FROM fl GROUP BY doc_id",
    "contig_best_max": f"WITH {BEST} SELECT doc_id, arg_max(item_id, (score, -item_id)) AS item_id, max(score) AS score FROM sc GROUP BY doc_id",
    "genome_vote": f"WITH {BEST}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM sc), g AS (SELECT doc_id, item_id // 4 AS genome, sum(score) AS part FROM t WHERE r <= 10 GROUP BY ALL), p AS (SELECT *, part / sum(part) OVER (PARTITION BY doc_id) AS share FROM g) SELECT doc_id, genome, round(share, 6) AS share FROM p WHERE share > 0.5",
    "freq_kmer_argmax": f"WITH {D}, {B}, {idx(12)}, al AS (SELECT kmer, min(item_id) AS item_id FROM ix GROUP BY kmer HAVING count(*) = 1), o AS (SELECT doc_id, {km('s', 12)} AS m FROM d), v AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT doc_id, item_id FROM o JOIN al ON kmer = m UNION ALL SELECT doc_id, item_id FROM o JOIN al ON kmer = {rc('m')}) GROUP BY ALL), w AS (SELECT doc_id, arg_max(item_id, (n, -item_id)) AS item_id, max(n) AS n FROM v GROUP BY doc_id) SELECT d.doc_id, coalesce(item_id, -1) AS item_id, coalesce(n, -1) AS n FROM d LEFT JOIN w USING (doc_id)",
    "protein_search": f"WITH {D}, {B}, {frames('d', 'doc_id')}, pi AS (SELECT DISTINCT item_id % 25 AS tid, {km('p', 4)} AS kmer FROM (SELECT item_id, {prot('s')} AS p FROM b)), wi AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY kmer) AS w FROM pi), fk AS (SELECT DISTINCT doc_id, frame, {km('protein', 4)} AS kmer FROM fp), bf AS (SELECT doc_id, frame, tid, sum(w) AS score FROM fk JOIN wi USING (kmer) GROUP BY ALL) SELECT doc_id, tid, round(max(score), 6) AS score FROM bf GROUP BY doc_id, tid",
    "lineage_array": "SELECT c_custkey, c_name || ';' || n_name || ';' || r_name AS ranks FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "lca": f"WITH {ANN}, {LIN}, t AS (SELECT doc_id, l0, l1, l2 FROM an JOIN lin ON item_id % 25 = tid), g AS (SELECT doc_id, count(DISTINCT l0) AS c0, count(DISTINCT l1) AS c1, count(DISTINCT l2) AS c2, min(l0) AS m0, min(l1) AS m1, min(l2) AS m2 FROM t GROUP BY doc_id) SELECT doc_id, CAST(CASE WHEN c0 = 1 THEN 0 WHEN c1 = 1 THEN 1 WHEN c2 = 1 THEN 2 ELSE 99 END AS BIGINT) AS level, CAST(CASE WHEN c0 = 1 THEN m0 WHEN c1 = 1 THEN m1 WHEN c2 = 1 THEN m2 ELSE 0 END AS BIGINT) AS taxon FROM g",
    "tax_edges": f"WITH {TREE} SELECT * FROM te",
    "leaf_counts": "SELECT n_name AS node, count(*) AS leafnum FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT r_name, count(*) FROM (SELECT r_name, c_name AS leaf FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) GROUP BY 1",
    "postorder": "WITH t AS (SELECT r_name AS a, n_name AS b, c_name AS c, c_name AS node FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name, NULL, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL, NULL, r_name FROM region UNION ALL SELECT NULL, NULL, NULL, 'ALL') SELECT node, row_number() OVER (ORDER BY a NULLS LAST, b NULLS LAST, c NULLS LAST) - 1 AS post_id FROM t",
    "heavy_child": f"WITH {CUST} SELECT n_regionkey, arg_max(n_nationkey, (n, -n_nationkey)) AS n_nationkey, max(n) AS n FROM cu GROUP BY n_regionkey",
    "sibling_order": f"WITH {CUST} SELECT n_regionkey, n_nationkey, n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, n_nationkey) AS rank FROM cu",
    "heavy_path": f"WITH {TREE}, nl AS (SELECT n.parent, n.child, greatest(count(c.child), 1) AS leaves FROM te n LEFT JOIN te c ON c.parent = n.child AND c.level = 1 WHERE n.level = 0 GROUP BY ALL), hn AS (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY leaves DESC, child) AS r FROM nl), nh AS (SELECT child AS node, CASE WHEN r = 1 THEN parent ELSE child END AS head FROM hn), hc AS (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY child) AS r FROM te WHERE level = 1) SELECT node, head FROM nh UNION ALL SELECT DISTINCT parent, parent FROM hn UNION ALL SELECT child, CASE WHEN r = 1 THEN head ELSE child END FROM hc JOIN nh ON hc.parent = nh.node",
    "match_level": f"WITH {BEST}, {LIN}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM sc) SELECT x.doc_id, CAST({match('la', 'lb', 3)} AS BIGINT) AS level FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.r = 1 AND y.r = 2 JOIN lin la ON la.tid = x.item_id % 25 JOIN lin lb ON lb.tid = y.item_id % 25",
    "lineage_rollup": "SELECT r_name AS prefix, count(*) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT r_name || ';' || n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "cluster_length_coverage": "SELECT c_mktsegment, round(sum(l_quantity), 2) AS length, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) AS coverage FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "species_score_union": f"WITH {UNION} SELECT * FROM su",
    "best_species": f"WITH {SPECIES} SELECT * FROM sp",
    "best_target_by_lineage": f"WITH {SPECIES}, {LIN}, x AS (SELECT sc.doc_id, sc.item_id, sc.score, {match('la', 'lb', 7)} AS level FROM sc JOIN sp ON sp.doc_id = sc.doc_id JOIN lin la ON la.tid = sc.item_id % 25 JOIN lin lb ON lb.tid = sp.tid), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level, score DESC, item_id) AS r FROM x) SELECT doc_id, CAST(level AS BIGINT) AS level, item_id, score FROM r WHERE r = 1",
    "cluster_topk_sum": f"WITH {BYSRC('sum')}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, item_id) AS rank FROM bs) SELECT * FROM r WHERE rank <= 10",
    "cluster_topk_max": f"WITH {BYSRC('max')}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, item_id) AS rank FROM bs) SELECT * FROM r WHERE rank <= 10",
    "cluster_report_sum": f"WITH {BYSRC('sum')}, r AS (SELECT *, count(*) OVER (PARTITION BY source) AS candidates, row_number() OVER (PARTITION BY source ORDER BY score DESC, item_id) AS rank FROM bs) SELECT * FROM r WHERE rank <= 10000",
    "cluster_report_max": f"WITH {BYSRC('max')}, r AS (SELECT *, count(*) OVER (PARTITION BY source) AS candidates, row_number() OVER (PARTITION BY source ORDER BY score DESC, item_id) AS rank FROM bs) SELECT * FROM r WHERE rank <= 10000",
    "topk_relative_cut": f"WITH {BYSRC('sum')}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, item_id) AS rank, max(score) OVER (PARTITION BY source) AS best FROM bs) SELECT source, item_id, score, rank FROM r WHERE rank <= 20 AND score * 20 >= best",
    "virtual_contigs": f"WITH {B} SELECT item_id // 4 AS genome, string_agg(CAST(item_id AS VARCHAR), '_' ORDER BY item_id) AS ids, string_agg(s, repeat('N', 100) ORDER BY item_id) AS seq FROM b GROUP BY 1",
    "entropy_majority": "WITH n AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY o_custkey) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS r FROM n) SELECT o_custkey, abs(round(sum(p * ln(p)), 6)) AS entropy, max(v) FILTER (r = 1) AS majority FROM p GROUP BY 1",
    "level_by_entropy": "WITH e AS (SELECT o_custkey, 0 AS level, o_orderpriority AS v FROM orders UNION ALL SELECT o_custkey, 1, o_orderstatus FROM orders UNION ALL SELECT o_custkey, 2, CAST(year(o_orderdate) AS VARCHAR) FROM orders), n AS (SELECT o_custkey, level, v, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY o_custkey, level) AS p, row_number() OVER (PARTITION BY o_custkey, level ORDER BY n DESC, v) AS r FROM n), t AS (SELECT o_custkey, level, abs(round(sum(p * ln(p)), 6)) AS entropy, max(v) FILTER (r = 1) AS majority FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY entropy >= 0.5 DESC, CASE WHEN entropy >= 0.5 THEN -level ELSE level END) AS k FROM t) SELECT o_custkey, CAST(level AS BIGINT) AS level, entropy, majority FROM k WHERE k = 1",
    "score_max_share": f"WITH {COMP} SELECT l_suppkey, round(max(p), 6) AS max_share FROM cp GROUP BY 1",
    "score_top2_gap": f"WITH {COMP} SELECT l_suppkey, round((max(n) - coalesce(max(n) FILTER (r = 2), 0)) / sum(n), 6) AS top2_gap FROM cp GROUP BY 1",
    "composition_log2": f"WITH {COMP} SELECT l_suppkey, round(sum(p * log2(p)), 6) AS log2_sum FROM cp GROUP BY 1",
    "confusion_cube": "SELECT CAST(quality AS BIGINT) AS ref, CAST(toxic AS BIGINT) AS pred, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
    "confusion_summary": "WITH c AS (SELECT CAST(l_linenumber AS BIGINT) AS ref, CAST(least(floor(l_quantity / 7), 7) AS BIGINT) AS p, CAST(least(floor(l_discount * 100), 7) AS BIGINT) AS c FROM lineitem), s AS (SELECT ref, count(*) FILTER (p < ref AND c <= ref) AS lower, count(*) FILTER (p > ref AND p < 7 AND c = p) AS high, count(*) FILTER (p = ref AND c = ref) AS corr, count(*) FILTER (p < 7 AND c < 7) AS i, count(*) AS total FROM c GROUP BY ref) SELECT ref, lower, high, corr, i - lower - high - corr AS tinc, total FROM s",
    "gaussian_confidence": "WITH l AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, count(*) AS p FROM events GROUP BY 1), v AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1), e AS (SELECT user_id, event_type, exp(-((v - m) * (v - m)) / (2 * s * s)) / (s * sqrt(2 * pi())) * p AS d FROM v, l) SELECT user_id, event_type, round(sum(d) OVER (PARTITION BY user_id ORDER BY event_type) / sum(d) OVER (PARTITION BY user_id), 6) AS confidence FROM e",
    "pair_stats": "WITH a AS (SELECT x.event_type = y.event_type AS same, abs(x.value - y.value) AS g FROM events x JOIN events y ON x.event_id % 2 = 0 AND y.event_id = x.event_id + 1) SELECT CAST(same AS BIGINT) AS same_type, CAST(floor(g / 10) AS BIGINT) AS bucket, count(*) AS n FROM a GROUP BY ALL",
    "cluster_accuracy": f"WITH {DL} SELECT round((SELECT sum(m) FROM (SELECT max(n) AS m FROM dl GROUP BY source)) / sum(n), 6) AS precision, round((SELECT sum(m) FROM (SELECT max(n) AS m FROM dl GROUP BY lang)) / sum(n), 6) AS sensitivity FROM dl",
    "purity": f"WITH {DL} SELECT source, round(max(n) / sum(n), 6) AS purity, arg_min(lang, (-n, lang)) AS majority FROM dl GROUP BY source",
    "level_statistics": f"WITH {LIN} SELECT CAST({match('a', 'b', 3)} AS BIGINT) AS level, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN lin a ON a.tid = c_nationkey JOIN lin b ON b.tid = s_nationkey GROUP BY 1",
    "pe_edges": f"WITH {PE} SELECT * FROM pe",
    "pe_node_weights": f"WITH {PE} SELECT node, CAST(sum(w) AS BIGINT) AS weight, count(*) AS degree FROM (SELECT u AS node, w FROM pe UNION ALL SELECT v, w FROM pe) GROUP BY 1",
    "components": f"WITH RECURSIVE {PE}, ed AS (SELECT u, v FROM pe WHERE w >= 3), {reach('ed', 'co')} SELECT node, comp FROM co",
    "pe_merge": f"WITH RECURSIVE {PE}, tw AS (SELECT node, sum(w) AS t FROM (SELECT u AS node, w FROM pe UNION ALL SELECT v, w FROM pe) GROUP BY 1), ra AS (SELECT u, v, w / greatest(a.t, b.t) AS ratio FROM pe JOIN tw a ON u = a.node JOIN tw b ON v = b.node), len AS (SELECT user_id AS node, count(*) AS length FROM events GROUP BY 1), pa0 AS (SELECT node, node AS comp FROM tw), {merge_pass(1, '0.04', False, 'pa0')}, {merge_pass(2, '0.03', True, 'pa1')}, {merge_pass(3, '0.025', True, 'pa2')} SELECT node, comp FROM pa3",
    "interval_merge": "WITH e AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e), i AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(a) AS island_start, max(b) AS island_end FROM i GROUP BY user_id, k",
    "overlap_mismatch": f"WITH {D}, p AS (SELECT x.doc_id, substr(x.s, x.doc_id % 5 + 1) AS a, y.s AS b FROM d x JOIN d y ON y.doc_id = x.doc_id + 1), n AS (SELECT *, least(length(a), length(b)) AS n, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i])) AS w FROM p) SELECT doc_id, CAST(n - w AS BIGINT) AS n_match, CAST(w AS BIGINT) AS n_mismatch FROM n",
    "suffix_array": f"WITH {SUF} SELECT item_id, rank, pos FROM sa",
    "bwt": f"WITH {SUF} SELECT item_id, string_agg(CASE WHEN pos = 0 THEN '$' ELSE substr(s, pos, 1) END, '' ORDER BY rank) AS bwt FROM sa GROUP BY item_id",
    "region_lookup_asof": "WITH r AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS e FROM lineitem), p AS (SELECT l_orderkey, unnest(range(0, max(e) + 1, 10)) AS pos FROM r GROUP BY l_orderkey), z AS (SELECT l_orderkey, max(line) AS last FROM r GROUP BY 1) SELECT p.l_orderkey, p.pos, coalesce(min(r.line), any_value(z.last)) AS line FROM p JOIN z ON z.l_orderkey = p.l_orderkey LEFT JOIN r ON r.l_orderkey = p.l_orderkey AND r.e > p.pos GROUP BY ALL",
    "common_kmers_all": f"WITH {B}, g AS (SELECT item_id // 4 AS genome, count(*) AS size FROM b GROUP BY 1), k AS (SELECT DISTINCT item_id // 4 AS genome, item_id, {km('s', 4)} AS kmer FROM b), c AS (SELECT genome, kmer, count(*) AS c FROM k GROUP BY ALL) SELECT genome, kmer FROM c JOIN g USING (genome) WHERE c = size",
    "common_substrings": f"WITH {B}, g AS (SELECT item_id // 4 AS genome, arg_min(s, item_id) AS f, list(s) AS ss FROM b GROUP BY 1), p AS (SELECT genome, f, ss, unnest(range(0, length(f))) AS pos FROM g), r AS (SELECT genome, pos, coalesce(list_max(list_filter(range(1, length(f) - pos + 1), lambda n: len(list_filter(ss, lambda x: NOT contains(x, substr(f, pos + 1, n)))) = 0)), 0) AS size FROM p), l AS (SELECT *, lag(size, 1, 0) OVER (PARTITION BY genome ORDER BY pos) AS b FROM r) SELECT genome, pos, size FROM l WHERE size >= 3 AND b <= size",
    "lcp_depth_clean": f"WITH {LCP} SELECT * FROM de",
    "lcp_depth_summary": f"WITH {LCP} SELECT item_id, round(avg(depth), 6) AS mean_depth, count(*) AS n FROM de GROUP BY 1",
    "read_classify": f"WITH {D}, o AS (SELECT doc_id, i, substr(s, i, 24) AS l FROM (SELECT doc_id, s, unnest(range(1, length(s) - 22)) AS i FROM d)), ix AS (SELECT l FROM (SELECT DISTINCT doc_id, l FROM o) GROUP BY l HAVING count(*) > 5), q AS (SELECT doc_id, substr(l, 13, 12) AS kmer, arg_max(l, i) AS l FROM o GROUP BY ALL) SELECT doc_id, count(*) AS n FROM q JOIN ix USING (l) GROUP BY doc_id",
    "species_gene_report": "WITH p AS (SELECT p_brand, count(*) AS n_genes, array_to_string(list_sort(list(DISTINCT p_type))[1:20], ',') AS genes FROM part WHERE p_size >= 10 GROUP BY 1 HAVING count(*) >= 10) SELECT * FROM p ORDER BY n_genes DESC, p_brand LIMIT 10",
    "annotation_report": f"WITH {MAP} SELECT source, item_id, count(*) AS n FROM rm GROUP BY ALL",
    "read_contig_map": f"WITH {MAP} SELECT doc_id, item_id FROM rm",
    "unassigned_bucket": f"WITH {ANN} SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM an) GROUP BY source",
    "multi_key_sort": "SELECT l_returnflag, l_linestatus, l_quantity, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_quantity DESC, l_orderkey, l_linenumber) AS rank FROM lineitem",
    "score_lines": f"WITH {ANN}, l AS (SELECT doc_id, string_agg(item_id || ' ' || score, ' ' ORDER BY item_id) AS line FROM an GROUP BY 1) SELECT d.doc_id AS ctg_id, coalesce(line, '') AS line FROM d LEFT JOIN l USING (doc_id)",
    "cluster_members": "SELECT c_mktsegment AS cluster, c_custkey AS read_id, CASE WHEN c_acctbal > 0 THEN c_name ELSE '< read ' || c_custkey END AS line FROM customer",
    "qmer_profile": f"WITH {D}, k AS (SELECT doc_id, {km('s', 4)} AS m FROM d) SELECT doc_id, least(m, {rc('m')}) AS qmer, count(*) AS n FROM k GROUP BY ALL",
    "read_overlaps": f"WITH RECURSIVE {B}, k AS (SELECT item_id, s, i, substr(s, i, 8) AS m FROM (SELECT item_id, s, unnest(range(1, length(s) - 6)) AS i FROM b)), p AS (SELECT DISTINCT x.item_id AS u, y.item_id AS v, x.i - y.i AS d, x.s AS su, y.s AS sv FROM k x JOIN k y ON x.m = y.m AND x.item_id < y.item_id), o AS (SELECT u, v, substr(CASE WHEN d >= 0 THEN su ELSE sv END, abs(d) + 1) AS a, CASE WHEN d >= 0 THEN sv ELSE su END AS b FROM p), q AS (SELECT u, v, least(length(a), length(b)) AS n, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i])) AS w FROM o), ed AS (SELECT DISTINCT u, v FROM q WHERE n - w >= 8 AND w <= 1), {reach('ed', 'co')} SELECT node, comp FROM co",
    "read_mapping": f"WITH {D}, {B}, r AS (SELECT item_id, i, substr(s, i, 12) AS m FROM (SELECT item_id, s, unnest(range(1, length(s) - 10)) AS i FROM b)), c AS (SELECT doc_id, i, substr(s, i, 12) AS m FROM (SELECT doc_id, s, unnest(range(1, length(s) - 10)) AS i FROM d)), p AS (SELECT DISTINCT item_id, doc_id, c.i - r.i AS pos FROM r JOIN c USING (m) WHERE c.i >= r.i), f AS (SELECT item_id, doc_id, pos, b.s AS rs, substr(d.s, pos + 1, length(b.s)) AS cs FROM p JOIN b USING (item_id) JOIN d USING (doc_id) WHERE pos + length(b.s) <= length(d.s)), q AS (SELECT item_id, doc_id, pos, length(rs) AS n, len(list_filter(range(1, length(rs) + 1), lambda i: rs[i] = cs[i])) AS score FROM f), w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, pos) AS k FROM q WHERE score >= 0.95::DOUBLE * n) SELECT item_id AS read_id, doc_id AS ctg_id, pos, CAST(score AS BIGINT) AS score FROM w WHERE k = 1",
    "near_best_lca": f"WITH {BEST}, {LIN}, nb AS (SELECT doc_id, item_id FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM sc) WHERE score >= 0.9::DOUBLE * m), g AS (SELECT doc_id, count(DISTINCT l0) AS c0, count(DISTINCT l1) AS c1, min(l0) AS m0, min(l1) AS m1 FROM nb JOIN lin ON item_id % 25 = tid GROUP BY doc_id) SELECT doc_id, CAST(CASE WHEN c0 = 1 THEN 0 WHEN c1 = 1 THEN 1 ELSE 2 END AS BIGINT) AS level, CASE WHEN c0 = 1 THEN m0 WHEN c1 = 1 THEN m1 ELSE 1 END AS taxon FROM g",
    "threshold_level": "WITH s AS (SELECT l_suppkey, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY 1) SELECT l_suppkey, score, CAST(CASE WHEN score >= 0.055 THEN 0 WHEN score >= 0.052 THEN 1 WHEN score >= 0.05 THEN 2 WHEN score >= 0.045 THEN 3 ELSE 4 END AS BIGINT) AS level FROM s",
    "rank_lineages": "SELECT c_custkey + 10000 AS tid, c_custkey + 10000 AS species, CAST(n_nationkey AS BIGINT) + 1000 AS genus, CAST(n_regionkey AS BIGINT) + 100 AS family, CAST(1 AS BIGINT) AS root FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 1000, 0, CAST(n_nationkey AS BIGINT) + 1000, CAST(n_regionkey AS BIGINT) + 100, 1 FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) + 100, 0, 0, CAST(r_regionkey AS BIGINT) + 100, 1 FROM region UNION ALL SELECT 1, 0, 0, 0, 1",
    "cluster_species_scores": f"WITH {BEST}, bd AS (SELECT doc_id, item_id % 25 AS tid, max(score) AS score FROM sc GROUP BY ALL) SELECT source, tid, CAST(sum(score) AS BIGINT) AS score FROM bd JOIN nation ON n_nationkey = tid JOIN documents USING (doc_id) WHERE n_regionkey <> 2 GROUP BY source, tid",
    "cluster_best": f"WITH {BYSRC('sum')}, w AS (SELECT source, arg_max(item_id, (score, -item_id)) AS item_id, max(score) AS score FROM bs GROUP BY source), e AS (SELECT DISTINCT source FROM documents) SELECT e.source, coalesce(item_id, -1) AS item_id, coalesce(item_id % 25, 0) AS tid, coalesce(score, 0) AS score FROM e LEFT JOIN w USING (source)",
    "ignored_targets": f"WITH {ANN} SELECT doc_id, item_id, score FROM an WHERE item_id % 25 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)",
    "genome_taxa": f"WITH {B} SELECT item_id AS seqid, CAST(s_nationkey AS BIGINT) AS taxid, length(s) AS size FROM b JOIN supplier ON s_suppkey = item_id",
    "region_genes": f"WITH {GENES} SELECT seqid, st AS start, en AS end, gene FROM ge",
    "genome_text": f"WITH {GENES} SELECT seqid, string_agg(gene || 'M', '' ORDER BY st, en) AS text FROM ge GROUP BY seqid",
    "genome_index": f"WITH {GENES} SELECT DISTINCT taxid, kmer FROM (SELECT CAST(s_nationkey AS BIGINT) AS taxid, {km('gene', 8)} AS kmer FROM ge JOIN supplier ON s_suppkey = seqid)",
    "edge_strings": f"WITH {B}, n AS (SELECT item_id, s, unnest(range(8, 12)) AS n FROM b) SELECT item_id, 'prefix' AS side, n AS size, left(s, n) AS part FROM n WHERE n <= length(s) UNION ALL SELECT item_id, 'suffix', n, right(s, n) FROM n WHERE n <= length(s)",
    "locate_counts": f"WITH {D}, {B}, o AS (SELECT m, count(*) AS n FROM (SELECT {km('s', 8)} AS m FROM d) GROUP BY m) SELECT item_id, coalesce(n, 0) AS n FROM b LEFT JOIN o ON m = left(s, 8) WHERE length(s) >= 8",
    "read_mapping_strands": f"WITH {STRANDS} SELECT read_id, ctg_id, pos, strand, score FROM w WHERE k = 1",
    "contig_read_edges": f"WITH {CONTIG_READ} SELECT ctg_id, read_id FROM ce",
    "contig_read_merge": f"WITH RECURSIVE {CONTIG_READ}, ed AS (SELECT ctg_id AS u, -1 - read_id AS v FROM ce), {reach('ed', 'co')} SELECT node, comp FROM co",
    "component_sizes": f"WITH RECURSIVE {PE}, ed AS (SELECT u, v FROM pe WHERE w >= 3), {reach('ed', 'co')} SELECT comp, count(*) AS n FROM co GROUP BY comp",
    "best_species_all": f"WITH {SPECIES} SELECT documents.doc_id, coalesce(tid, 0) AS tid, coalesce(score, 0) AS score FROM documents LEFT JOIN sp ON sp.doc_id = documents.doc_id",
    "genome_vote_counts": f"WITH {BEST}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM sc) SELECT doc_id, count(DISTINCT item_id // 4) AS genomes, count(*) AS targets FROM t WHERE r <= 10 GROUP BY doc_id",
    "composition_log2_all": "WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey, n / sum(n) OVER (PARTITION BY o_custkey) AS p FROM n), l AS (SELECT o_custkey, sum(p * log2(p)) AS l FROM p GROUP BY 1) SELECT c_custkey, round(coalesce(l, 1e9), 6) AS log2_sum FROM customer LEFT JOIN l ON o_custkey = c_custkey",
    "confusion_variants": "WITH x AS (SELECT CAST(l_linenumber AS BIGINT) AS ref, CAST(l_quantity AS BIGINT) AS w, CAST(least(floor(l_quantity / 7), 7) AS BIGINT) AS p, CAST(least(floor(l_discount * 100), 7) AS BIGINT) AS q, CAST(least(floor(l_tax * 100), 7) AS BIGINT) AS correct FROM lineitem) SELECT variant, ref, pred, correct, CAST(sum(w) AS BIGINT) AS n_reads, count(*) AS n_ctgs FROM (SELECT 'own' AS variant, ref, p AS pred, correct, w FROM x UNION ALL SELECT 'nearest', ref, q, correct, w FROM x) GROUP BY ALL",
    "pair_mapping": "WITH e AS (SELECT event_id, CASE WHEN value >= 50 THEN user_id % 10 END AS t, CAST(floor(value) AS BIGINT) AS s FROM events), p AS (SELECT x.t AS t0, y.t AS t1, x.s AS s0, y.s AS s1 FROM e x JOIN e y ON x.event_id % 2 = 0 AND y.event_id = x.event_id + 1), k AS (SELECT CASE WHEN t0 IS NULL AND t1 IS NULL THEN 'unmapped' WHEN t0 IS NULL OR t1 IS NULL THEN 'half' WHEN t0 <> t1 THEN 'mixed' END AS kind, CASE WHEN t0 IS NULL AND t1 IS NOT NULL THEN s0 WHEN t1 IS NULL AND t0 IS NOT NULL THEN s1 END AS score FROM p) SELECT kind, coalesce(score, -1) AS score, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL",
    "leaf_parents": f"WITH {TREE}, i AS (SELECT DISTINCT parent FROM te) SELECT te.parent AS node, count(*) AS children, count(*) FILTER (i.parent IS NULL) AS leaves FROM te LEFT JOIN i ON i.parent = te.child GROUP BY te.parent HAVING count(*) FILTER (i.parent IS NULL) >= 2",
    "length_extremes": "SELECT lang, count(n) AS sequences, max(n) AS longest, min(n) AS shortest FROM (SELECT lang, length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) AS n FROM documents) GROUP BY lang",
    "cluster_annotation": f"WITH {BYSRC('sum')}, x AS (SELECT source, item_id FROM (SELECT *, max(score) OVER (PARTITION BY source) AS m FROM bs) WHERE score = m), t AS (SELECT source, count(DISTINCT n_name) AS cn, count(DISTINCT r_name) AS cr, min(n_name) AS nn, min(r_name) AS rn FROM x JOIN nation ON n_nationkey = item_id % 25 JOIN region ON r_regionkey = n_regionkey GROUP BY source), c AS (SELECT source, count(*) AS n, round(avg(length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) / nullif(length(text), 0)), 6) AS coverage FROM documents GROUP BY source) SELECT c.source, CASE WHEN cn = 1 THEN 'nation' WHEN cr = 1 THEN 'region' WHEN cn > 1 THEN 'root' ELSE 'none' END AS level, CASE WHEN cn = 1 THEN nn WHEN cr = 1 THEN rn ELSE '' END AS taxon, n, coverage FROM c LEFT JOIN t ON t.source IS NOT DISTINCT FROM c.source",
    "confusion_matrix": "WITH c AS (SELECT CAST(l_linenumber AS BIGINT) AS ref, least(floor(l_quantity / 7), 7) AS p FROM lineitem) SELECT ref, " + ", ".join(f"count(*) FILTER (p = {k}) AS p{k}" for k in range(8)) + " FROM c GROUP BY ref",
    "genome_hit_lines": f"WITH {BEST}, g AS (SELECT doc_id, item_id // 4 AS genome, CAST(sum(score) AS BIGINT) AS n FROM sc GROUP BY ALL), l AS (SELECT doc_id, string_agg(genome || ' ' || n, ' ' ORDER BY genome) AS line FROM g GROUP BY 1) SELECT d.doc_id AS ctg_id, coalesce(line, '') AS line FROM d LEFT JOIN l USING (doc_id)",
    "best_species_by_set": f"WITH {BEST}, {hits('d', 'doc_id', name='h2')}, f AS (SELECT doc_id, item_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id, a) AS w FROM h2), x AS (SELECT source, item_id % 25 AS tid, CAST(sum(score) AS DOUBLE) AS v, 'hits' AS kind FROM sc JOIN documents USING (doc_id) GROUP BY ALL UNION ALL SELECT source, item_id % 25, round(sum(w), 6), 'shares' FROM f JOIN documents USING (doc_id) GROUP BY ALL UNION ALL SELECT DISTINCT source, CAST(NULL AS BIGINT), NULL, NULL FROM documents) SELECT source, coalesce(arg_max(tid, (v, -tid)) FILTER (kind = 'hits'), 0) AS by_hits, coalesce(arg_max(tid, (v, -tid)) FILTER (kind = 'shares'), 0) AS by_shares FROM x GROUP BY source",
    "cluster_k_scores": f"WITH {D}, {B}, {idx(8, 'i8')}, {idx(12, 'i12')}, {hits('d', 'doc_id', 8, 'ha', 'i8')}, {hits('d', 'doc_id', 12, 'hb', 'i12')}, n AS (SELECT doc_id, item_id, 8 AS k, count(*) AS n FROM ha GROUP BY ALL UNION ALL SELECT doc_id, item_id, 12, count(*) FROM hb GROUP BY ALL), s AS (SELECT source, item_id, CAST(k AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS total, max(n) AS m FROM n JOIN documents USING (doc_id) GROUP BY ALL) SELECT source, item_id, k, total, max(m) OVER (PARTITION BY source, item_id) AS best FROM s",
    "cluster_best_fixed": f"WITH {BEST}, bs AS (SELECT source, item_id, CAST(sum(score) AS BIGINT) AS total, max(score) AS most FROM sc JOIN documents USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY most >= 20 DESC, CASE WHEN most >= 20 THEN most ELSE total END DESC, item_id) AS k FROM bs) SELECT source, item_id, CASE WHEN most >= 20 THEN most ELSE total END AS score FROM r WHERE k = 1",
}
_MATRIX = f"{LIN}, mx AS (SELECT l_returnflag AS k, s_nationkey AS i, c_nationkey AS j, avg(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), lv AS (SELECT k, CAST(i AS BIGINT) AS genome, CAST(CASE WHEN x.l0 = y.l0 THEN 0 WHEN x.l1 = y.l1 THEN 1 ELSE 2 END AS BIGINT) AS level, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM mx JOIN lin x ON x.tid = i JOIN lin y ON y.tid = j GROUP BY ALL)"
_CROSS = "nx AS (SELECT *, lead(mean) OVER g AS m2, lead(sd) OVER g AS s2, lead(n) OVER g AS n2 FROM lv WINDOW g AS (PARTITION BY k, genome ORDER BY level)), q AS (SELECT *, 1 / (2 * sd * sd) - 1 / (2 * s2 * s2) AS a, m2 / (s2 * s2) - mean / (sd * sd) AS b, mean * mean / (2 * sd * sd) - m2 * m2 / (2 * s2 * s2) + ln(CAST(n2 AS DOUBLE) * sd / (n * s2)) AS c FROM nx WHERE sd > 0 AND s2 > 0), r AS (SELECT *, CASE WHEN b * b - 4 * a * c >= 0 AND abs(a) >= 1e-12 THEN (-b - sqrt(b * b - 4 * a * c)) / (2 * a) END AS r1, CASE WHEN b * b - 4 * a * c >= 0 AND abs(a) >= 1e-12 THEN (-b + sqrt(b * b - 4 * a * c)) / (2 * a) WHEN abs(a) < 1e-12 AND b <> 0 THEN -c / b END AS r2 FROM q), up AS (SELECT nx.k, nx.genome, nx.level, nx.mean, CASE WHEN nx.m2 IS NOT NULL THEN coalesce(CASE WHEN r1 BETWEEN least(nx.mean, nx.m2) AND greatest(nx.mean, nx.m2) THEN r1 END, CASE WHEN r2 BETWEEN least(nx.mean, nx.m2) AND greatest(nx.mean, nx.m2) THEN r2 END, (nx.mean + nx.m2) / 2) END AS upper FROM nx LEFT JOIN r USING (k, genome, level))"
_NEAREST = "WITH x AS (SELECT CAST(l_linenumber AS BIGINT) AS ref, CAST(l_quantity AS BIGINT) AS w, CAST(least(floor(l_quantity / 7), 7) AS BIGINT) AS pred, least(floor(l_discount * 100), 7) <= l_linenumber AS nearest_right, CAST(least(floor(l_tax * 100), 7) AS BIGINT) AS correct FROM lineitem)"
ORACLES |= {
    "confusion_nearest": f"{_NEAREST}, g AS (SELECT nearest_right, ref, pred, correct, CAST(sum(w) AS BIGINT) AS n_reads, count(*) AS n_ctgs FROM x GROUP BY ALL) SELECT *, round(CAST(coalesce(sum(n_reads) FILTER (pred >= 7) OVER p, 0) AS DOUBLE) / sum(n_reads) OVER p, 6) AS unassigned FROM g WINDOW p AS (PARTITION BY nearest_right, ref)",
    "best_target_all": f"SELECT doc_id, CAST(coalesce(level, 7) AS BIGINT) AS level, coalesce(item_id, 0) AS item_id, coalesce(score, 0) AS score FROM documents LEFT JOIN ({ORACLES['best_target_by_lineage']}) USING (doc_id)",
    "gene_species": f"WITH {ANN} SELECT lang AS species, item_id AS gene, count(*) AS contigs FROM an JOIN documents USING (doc_id) WHERE score >= 7 AND lang IS NOT NULL GROUP BY ALL",
    "node_kmers": f"WITH {B}, l AS (SELECT item_id, n_name, r_name FROM b JOIN nation ON n_nationkey = item_id % 25 JOIN region ON n_regionkey = r_regionkey), up AS (SELECT item_id, n_name AS node FROM l UNION ALL SELECT item_id, r_name FROM l UNION ALL SELECT CAST(NULL AS BIGINT), r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (SELECT item_id % 25 FROM b)), k AS (SELECT DISTINCT item_id, {km('s', 4)} AS kmer FROM b) SELECT node, any_value(leaves) AS leaves, kmer FROM (SELECT *, (SELECT count(*) FROM up x WHERE x.node = up.node) AS leaves FROM up) JOIN k USING (item_id) GROUP BY node, kmer HAVING count(*) = any_value(leaves)",
    "learned_levels": f"WITH {_MATRIX} SELECT k, genome, level, n, round(mean, 4) AS mean, round(sd, 4) AS sd FROM lv",
    "level_descent": f"WITH {_MATRIX}, {_CROSS}, b AS (SELECT k, genome, max(mean) FILTER (level = 0) AS a0, max(mean) FILTER (level = 1) AS a1, max(upper) FILTER (level = 0) AS u0, max(upper) FILTER (level = 1) AS u1 FROM up GROUP BY ALL), c AS (SELECT l_returnflag AS k, l_suppkey, CAST(any_value(s_nationkey) AS BIGINT) AS genome, round(avg(l_extendedprice), 2) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT k, l_suppkey, genome, score, CAST(CASE WHEN u0 IS NULL AND a0 IS NULL AND a1 IS NULL AND u1 IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM lv WHERE lv.k = c.k AND lv.genome = c.genome) THEN 2 ELSE 0 END WHEN score >= u0 THEN 0 WHEN score >= u1 THEN 1 ELSE 2 END AS BIGINT) AS by_boundary, CAST(CASE WHEN a0 IS NULL AND a1 IS NULL AND NOT EXISTS (SELECT 1 FROM lv WHERE lv.k = c.k AND lv.genome = c.genome) THEN 0 WHEN score >= a0 THEN 0 WHEN score >= a1 THEN CASE WHEN score >= a0 * 0.8::DOUBLE THEN 0 ELSE 1 END ELSE 2 END AS BIGINT) AS by_mean FROM c LEFT JOIN b USING (k, genome)",
    "read_classify_extended": f"WITH RECURSIVE {D}, {B}, q AS (SELECT item_id, kmer, arg_max(before, i) AS before FROM (SELECT item_id, i, substr(s, i, 8) AS kmer, substr(s, greatest(i - 12, 1), least(i - 1, 12)) AS before FROM (SELECT item_id, s, unnest(range(1, length(s) - 6)) AS i FROM b)) GROUP BY ALL), w AS (SELECT doc_id, substr(s, greatest(i - 12, 1), least(i - 1, 12) + 8) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) - 6)) AS i FROM d) WHERE substr(s, i, 8) IN (SELECT kmer FROM q)), h AS (SELECT pattern, count(DISTINCT doc_id) AS texts FROM (SELECT doc_id, right(w, n) AS pattern FROM (SELECT doc_id, w, unnest(range(8, length(w) + 1)) AS n FROM w)) GROUP BY pattern), st AS (SELECT kmer, before, 0 AS t, kmer AS pattern FROM (SELECT DISTINCT kmer, before FROM q) UNION ALL SELECT kmer, before, t + 1, coalesce(h.pattern, st.pattern) FROM st LEFT JOIN h ON h.pattern = substr(before, length(before) - t, 1) || st.pattern AND t < length(before) WHERE t < 12) SELECT item_id, count(*) AS n FROM q JOIN st USING (kmer, before) JOIN h USING (pattern) WHERE t = 12 AND texts > 2 GROUP BY item_id",
    "set_substrings": f"WITH {B}, g AS (SELECT item_id // 4 AS genome, list(s) AS ss FROM b GROUP BY 1), p AS (SELECT genome, item_id, s AS f, ss, unnest(range(0, length(s))) AS pos FROM b JOIN g ON genome = item_id // 4), r AS (SELECT genome, item_id, pos, coalesce(list_max(list_filter(range(1, length(f) - pos + 1), lambda n: len(list_filter(ss, lambda x: NOT contains(x, substr(f, pos + 1, n)))) = 0)), 0) AS size FROM p), l AS (SELECT *, lag(size, 1, 0) OVER (PARTITION BY item_id ORDER BY pos) AS b FROM r) SELECT genome, item_id, pos, size FROM l WHERE size >= 3 AND b <= size",
    "fasta_file": f"WITH {B} SELECT item_id, item_id || ' >' || regexp_replace(text, '[^A-Za-z]', '>', 'g') AS header, s FROM b JOIN benchmark USING (item_id)",
    "region_file": "SELECT DISTINCT l_orderkey AS seqid, CAST(l_linenumber * 9 - 12 AS BIGINT) AS start, CAST(l_linenumber * 9 - 12 + CAST(l_quantity AS BIGINT) AS BIGINT) AS end FROM lineitem WHERE l_linenumber * 9 - 12 >= 0",
}
_MAPPED = f"rm AS ({ORACLES['read_mapping']})"
_GOOD = f"n - w >= 8 AND n - w - 8 >= CAST(trunc(greatest(n - 8, 0) * {_P} - sqrt({_P} * (1 - {_P}) * greatest(n - 8, 0)) * 1.65::DOUBLE) AS BIGINT)"
ORACLES |= {
    "read_group_merge": f"WITH RECURSIVE {_MAPPED}, ed AS (SELECT DISTINCT x.ctg_id AS u, y.ctg_id AS v FROM rm x JOIN rm y ON x.read_id % 2 = 0 AND y.read_id = x.read_id + 1 WHERE x.ctg_id <> y.ctg_id), {reach('ed', 'co')} SELECT node, comp FROM co",
    "read_merge": f"WITH RECURSIVE {_MAPPED}, op AS ({ORACLES['read_overlaps'].split(', ed AS ')[0].replace('WITH RECURSIVE', 'WITH', 1)} SELECT DISTINCT u, v FROM q WHERE {_GOOD}), ed AS (SELECT DISTINCT x.ctg_id AS u, y.ctg_id AS v FROM op JOIN rm x ON x.read_id = op.u JOIN rm y ON y.read_id = op.v WHERE x.ctg_id <> y.ctg_id), {reach('ed', 'co')} SELECT node, comp FROM co",
}
