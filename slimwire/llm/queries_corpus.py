"""Registered queries of operators 11 to 13 and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slimwire.llm import manifest, resample, sharding
from slimwire.llm.common import table
from slimwire.llm.queries import ORACLE, query


@query
def op11_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# -- crc32 of text in SQL: the table of the reflected polynomial from its rule, then byte by byte -------------------

CRC_TABLE_SQL = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) FROM range(256) t(i))"


def crc_sql(text: str, crc_table: str) -> str:
    byte_list = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {byte_list}), lambda c, b: xor({crc_table}[(xor(c, b) & 255) + 1], c >> 8)))"


# -- operator 11: draws of the hash tree; the last region's draws go on until they end at a standing shard ------------

TURNS = 200  # draws of the open region that SQL follows: more have a chance of 0.75 ** 200


def mix_sql(x: str) -> str:
    """The scramble of 64-bit integers in wide arithmetic."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = f"list_transform({x}, lambda v: CAST((CAST(xor(v, v >> {shift}) AS UHUGEINT) * CAST({factor} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT))"
    return f"list_transform({x}, lambda v: xor(v, v >> 31))[1]"


def step_sql(state: str, to: str) -> str:
    return mix_sql(f"[CAST((CAST({state} AS UHUGEINT) + (CAST({to} AS UHUGEINT) + 1) * CAST({0x9E3779B97F4A7C15} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)]")


def wait_sql(state: str, weight: float) -> str:
    return f"-ln((CAST({state} >> 11 AS DOUBLE) + 0.5) / 9007199254740992.0) / {weight}"


def shard_sql(shards: int = sharding.SHARDS, racks: int = sharding.RACKS, places: int = sharding.PLACES) -> str:
    per = racks * places
    regions = (shards + per) // per
    rack_waits = ", ".join(wait_sql(step_sql("state", str(k)), float(places)) for k in range(racks))
    place_waits = ", ".join(wait_sql(step_sql("rack_state", str(p)), 1.0) for p in range(places))

    def located(n: int, name: str) -> str:
        return f"""{name} AS (SELECT key, arg_min(shard, clock) AS shard FROM (SELECT key, region, arg_min(shard, turn) AS shard, arg_min(clock, turn) AS clock
   FROM clocks WHERE shard < {n} GROUP BY key, region) GROUP BY key)"""

    return f"""WITH crc AS (SELECT {CRC_TABLE_SQL} AS t),
 d AS (SELECT doc_id, coalesce(text, '') AS text, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS UBIGINT) AS key FROM documents),
 e AS (SELECT key, r AS region, turn, {step_sql('key', 'r')} AS own FROM (SELECT DISTINCT key FROM d), range({regions}) a(r), range({TURNS}) b(turn)
       WHERE turn = 0 OR r = {regions - 1}),
 s AS (SELECT *, {step_sql('own', 'turn')} AS state FROM e),
 w AS (SELECT *, {wait_sql('state', float(per))} AS wait, [{rack_waits}] AS rack_waits FROM s),
 k AS (SELECT *, list_position(rack_waits, list_min(rack_waits)) - 1 AS rack FROM w),
 p AS (SELECT *, {step_sql('state', 'rack')} AS rack_state FROM k),
 q AS (SELECT *, [{place_waits}] AS place_waits FROM p),
 clocks AS (SELECT key, region, turn, region * {per} + rack * {places} + list_position(place_waits, list_min(place_waits)) - 1 AS shard,
                   sum(wait) OVER (PARTITION BY key, region ORDER BY turn) AS clock FROM q),
 {located(shards, 'now')}, {located(shards + 1, 'grown')},
 o AS (SELECT doc_id, key, CAST(strlen(text) + 1 AS BIGINT) AS size, CAST({crc_sql('text', 'crc.t')} AS BIGINT) AS text_crc32 FROM d, crc)
SELECT doc_id, size, text_crc32, '{sharding.LAW}' AS law, CAST(now.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY now.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown.shard AS INTEGER) AS grown_shard
FROM o JOIN now USING (key) JOIN grown USING (key)"""


# -- operator 12 ------------------------------------------------------------------------------------------------

RESAMPLE_SQL = f"""WITH crc AS (SELECT {CRC_TABLE_SQL} AS t),
 t AS (SELECT row_number() OVER () AS n, 'd' AS part, doc_id, text FROM documents UNION ALL SELECT row_number() OVER (), 'b', NULL, text FROM benchmark),
 f AS (SELECT n, part, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM t),
 u AS (SELECT n, part, unnest(w) AS w FROM f),
 v AS (SELECT w, {crc_sql('w', 'crc.t')} % {resample.BUCKETS} AS b FROM (SELECT DISTINCT w FROM u), crc),
 c AS (SELECT b, count(*) FILTER (part = 'd') AS s, count(*) FILTER (part = 'b') AS t FROM u JOIN v USING (w) GROUP BY b),
 g AS (SELECT b, floor({resample.SCALE} * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + {resample.SMOOTH}) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + {resample.SMOOTH})))) AS gain FROM c),
 m AS (SELECT n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM u JOIN v USING (w) JOIN g USING (b) WHERE part = 'd' GROUP BY n),
 h AS (SELECT f.n, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
              CAST('0x' || substr(sha256('{resample.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM f LEFT JOIN m USING (n) WHERE part = 'd'),
 x AS (SELECT *, weight + CAST(floor(-{resample.SCALE}.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h),
 r AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank, count(*) OVER () AS able FROM x WHERE n_features >= {resample.LEAST_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN rank <= able * {resample.PERCENT} // 100 THEN rank END AS rank
FROM x LEFT JOIN r USING (n)"""


# -- operator 13: every level of every tree as rows, siblings by place, proofs folded as lists --------------------------

def _levels_sql(name: str, leaves: str, levels: int) -> str:
    """All nodes (g, l, i, h) of the trees whose leaves (g, i, h) are given, level by level while more than one remains."""
    out = [f"{name}0 AS (SELECT g, 0 AS l, i, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT g, {k + 1} AS l, i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (any_value(n) + 1) // 2 AS n FROM {name}{k} WHERE n > 1 GROUP BY g, i // 2)")
    out.append(f"{name} AS ({' UNION ALL '.join(f'SELECT * FROM {name}{k}' for k in range(levels + 1))})")
    return ",\n ".join(out)


def _steps_sql(name: str, tree: str, levels: int) -> str:
    """For each leaf of the trees its witness: a side and a digest a level, empty without a sibling."""
    return f"""{name} AS (SELECT t.g, t.i, list(CASE WHEN s.h IS NULL THEN '' WHEN (t.i >> a.l) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY a.l) AS steps
  FROM {tree} t JOIN (SELECT DISTINCT g, l FROM {tree} WHERE n > 1) a ON a.g = t.g
  LEFT JOIN {tree} s ON s.g = t.g AND s.l = a.l AND s.i = xor(t.i >> a.l, 1) WHERE t.l = 0 GROUP BY t.g, t.i)"""


def _leaf_sql(n_chars: str) -> str:
    fields = [n_chars if c == "n_chars" else c for c in manifest.FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in fields) + ")"


def manifest_sql(levels: int = 24, lang_levels: int = 8) -> str:
    """``levels``: leaves of a language are 2 ** levels at most; ``lang_levels``: languages, likewise."""
    return f"""WITH crc AS (SELECT {CRC_TABLE_SQL} AS t),
 d AS (SELECT doc_id, coalesce('.' || lang, '') AS g, {_leaf_sql('n_chars')} AS h,
              {_leaf_sql(f"(n_chars + CASE WHEN {crc_sql('CAST(doc_id AS VARCHAR)', 'crc.t')} % {manifest.TAMPERED} = 0 THEN 1 ELSE 0 END)")} AS changed FROM documents, crc),
 leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
 {_levels_sql('t', 'leaves', levels)},
 ends AS (SELECT '' AS g, g AS own, row_number() OVER (ORDER BY g) - 1 AS i, h FROM t WHERE n = 1),
 {_levels_sql('o', 'ends', lang_levels)},
 {_steps_sql('ts', 't', levels)},
 {_steps_sql('os', 'o', lang_levels)},
 p AS (SELECT doc_id, leaves.h AS leaf, changed, ends.h AS subroot, list_concat(coalesce(ts.steps, []), coalesce(os.steps, [])) AS steps
       FROM leaves JOIN ends ON ends.own = leaves.g LEFT JOIN ts ON ts.g = leaves.g AND ts.i = leaves.i LEFT JOIN os ON os.i = ends.i),
 r AS (SELECT h AS root FROM o WHERE n = 1),
 f AS (SELECT *, list_reduce(list_prepend(changed, steps), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM p, r)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(steps, lambda s: s[2:])), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""


ORACLE.update({"op11_shard_tree": shard_sql(), "op12_importance_resample": RESAMPLE_SQL, "op13_merkle_manifest": manifest_sql()})
