"""Read-shaped projections of the base tables, as expressions that Spark and DuckDB evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOOLS = ["t0", "t1", "t2", "t3"]

_TRUTH = [
    "o_orderkey AS rid",
    "CAST(o_orderkey AS STRING) AS qname",
    "0 AS mate",
    "concat('chr', CAST(o_custkey % 5 AS STRING)) AS contig",
    "(o_orderkey * 7919) % 100000 AS start0",
    "(o_orderkey * 7919) % 100000 + 100 + o_custkey % 51 AS end0",
    "CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand",
    "o_custkey",
]
_ANNOT_PART = ["'ptype' AS set_name", "concat('chr', CAST(p_partkey % 5 AS STRING)) AS contig", "(p_partkey * 613) % 100000 AS start0", "(p_partkey * 613) % 100000 + p_size * 40 AS end0", "p_type AS label"]
_ANNOT_SUPPLIER = ["'conf' AS set_name", "concat('chr', CAST(s_suppkey % 5 AS STRING)) AS contig", "(s_suppkey * 7717) % 100000 AS start0", "(s_suppkey * 7717) % 100000 + 4000 AS end0", "'confident' AS label"]
_POINTS = ["concat('chr', CAST(user_id % 5 AS STRING)) AS contig", "(event_id * 1237) % 100000 AS pos"]
_BASES = ["rid", "qname", "translate(CAST(rid * 7919 + o_custkey * 104729 AS STRING), '0123456789', 'ACGTACGTAC') AS seq"]
_CIGARS = [
    "rid",
    "concat(CAST(o_custkey % 9 + 1 AS STRING), 'S', CAST(rid % 50 + 1 AS STRING), 'M', CAST(rid % 3 + 1 AS STRING), 'I', CAST(o_custkey % 30 + 1 AS STRING), 'M') AS cigar",
]


def _aln(k: int) -> tuple[list[str], str]:
    shift = f"CASE (rid * {2 * k + 3} + {k}) % 19 WHEN 0 THEN 5000 WHEN 1 THEN 120 WHEN 2 THEN 75 ELSE rid % 4 END"
    other = f"(rid * 5 + {3 * k}) % 29 = 0"
    columns = [
        "qname",
        "mate",
        f"(rid * 11 + {17 * k}) % 23 <> 0 AS mapped",
        f"CASE WHEN {other} THEN concat('chr', CAST((o_custkey + 1) % 5 AS STRING)) ELSE contig END AS contig",
        f"start0 + {shift} AS start0",
        f"end0 + {shift} AS end0",
        f"CASE WHEN rid % 97 = {k} THEN '?' ELSE strand END AS strand",
        f"CASE WHEN (rid * {2 * k + 3} + {k}) % 19 < 2 OR {other} THEN (rid % 4) * 15 ELSE 60 - (rid % 3) * 15 END AS mapq",
        "CASE WHEN rid % 53 = 0 THEN -1 ELSE rid % 7 END AS nm",
        "end0 - start0 AS read_len",
        "rid % 20 AS clipped",
        "rid % 31 = 0 AS split",
    ]
    return columns, f"(rid * 7 + {13 * k}) % 41 <> 0"


_PROVIDER = _aln(5)[1] + " AND (rid * 11 + 85) % 23 <> 0 AND rid % 3 <> 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_TRUTH)


def aln(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    columns, kept = _aln(k)
    return truth(spark, sf_dir).filter(kept).selectExpr(*columns)


def tools(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: aln(spark, sf_dir, k) for k, name in enumerate(TOOLS)}


def provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth(spark, sf_dir).filter(_PROVIDER).selectExpr(*_aln(5)[0])


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").selectExpr(*_ANNOT_PART)
    return parts.unionByName(table(spark, sf_dir, "supplier").selectExpr(*_ANNOT_SUPPLIER))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr(*_POINTS)


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth(spark, sf_dir).selectExpr(*_BASES)


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth(spark, sf_dir).selectExpr(*_CIGARS)


def _select(columns: list[str], source: str, where: str = "") -> str:
    return f"SELECT {', '.join(columns)} FROM {source}" + (f" WHERE {where}" if where else "")


#: The same tables as common table expressions for the oracles; each may use those above it.
CTES = {
    "truth": _select(_TRUTH, "orders"),
    **{f"aln{k}": _select(_aln(k)[0], "truth", _aln(k)[1]) for k in range(4)},
    "provider": _select(_aln(5)[0], "truth", _PROVIDER),
    "annot": _select(_ANNOT_PART, "part") + " UNION ALL " + _select(_ANNOT_SUPPLIER, "supplier"),
    "points": _select(_POINTS, "events", "event_type = 'error'"),
    "bases": _select(_BASES, "truth"),
    "cigars": _select(_CIGARS, "truth"),
    "placements": " UNION ALL ".join(f"SELECT 't{k}' AS aligner, {k} AS place, * FROM aln{k}" for k in range(4)),
    "merged": """SELECT set_name, label, contig, min(start0) AS start0, max(end0) AS end0 FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY set_name, label, contig ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS block FROM (
        SELECT *, CASE WHEN start0 <= max(end0) OVER (PARTITION BY set_name, label, contig ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          THEN 0 ELSE 1 END AS fresh FROM annot)) GROUP BY set_name, label, contig, block""",
    "covered": """SELECT t.rid, m.set_name, m.label, sum(least(t.end0, m.end0) - greatest(t.start0, m.start0))::BIGINT AS covered, any_value(t.end0 - t.start0) AS length
      FROM truth t JOIN merged m ON t.contig = m.contig AND t.start0 < m.end0 AND m.start0 < t.end0 GROUP BY ALL""",
    "dominant": """SELECT t.rid, s.set_name, CASE WHEN coalesce(fraction, 0) >= 0.5 THEN c.label ELSE 'none' END AS label, coalesce(fraction, 0)::DOUBLE AS fraction
      FROM truth t CROSS JOIN (SELECT DISTINCT set_name FROM annot) s LEFT JOIN (
        SELECT *, covered::DOUBLE / length AS fraction FROM covered QUALIFY row_number() OVER (PARTITION BY rid, set_name ORDER BY covered::DOUBLE / length DESC, label) = 1
      ) c ON c.rid = t.rid AND c.set_name = s.set_name""",
    "labels2": """SELECT rid, set_name, CASE WHEN set_name = 'conf' AND label = 'none' THEN 'outside_confident' ELSE label END AS label,
      CASE WHEN fraction <= 0 THEN 'none' WHEN fraction < 0.5 THEN 'partial_<50%' WHEN fraction < 0.95 THEN 'mostly_50-95%' ELSE 'entire_>=95%' END AS cover FROM dominant""",
    "outcomes": """SELECT p.aligner, t.rid, t.qname, t.mate, t.contig, t.start0, t.end0, t.strand, o_custkey,
        coalesce(a.mapped, false) AS mapped, a.contig AS a_contig, a.start0 AS a_start, a.end0 AS a_end, a.strand AS a_strand, coalesce(a.mapq, 0)::BIGINT AS mapq, coalesce(a.nm, -1) AS nm,
        coalesce(a.clipped, 0) AS clipped, coalesce(a.split, false) AS split, coalesce(a.mapped AND a.contig = t.contig, false) AS same,
        CASE WHEN a.mapped AND a.contig = t.contig THEN greatest(0, least(t.end0, a.end0) - greatest(t.start0, a.start0))::DOUBLE / (greatest(t.end0, a.end0) - least(t.start0, a.start0)) ELSE 0 END AS share
      FROM truth t CROSS JOIN (SELECT unnest(['t0', 't1', 't2', 't3']) AS aligner) p LEFT JOIN placements a ON a.aligner = p.aligner AND a.qname = t.qname AND a.mate = t.mate""",
    "scored": """SELECT *, CASE WHEN NOT mapped THEN 'unmapped' WHEN same AND share > 0.1::DOUBLE THEN 'correct' ELSE 'misplaced' END AS outcome, CAST(share AS FLOAT) AS iou,
      mapped AND coalesce(strand = a_strand, false) AS strand_ok FROM outcomes""",
    "kinds": """SELECT *, CASE WHEN outcome <> 'misplaced' THEN '' WHEN NOT same THEN 'other_contig' WHEN share > 0 THEN 'same_locus_low_overlap' ELSE 'same_contig_elsewhere' END AS misplaced_kind FROM scored""",
    "per_mapq": "SELECT aligner, mapq, count(*) AS n_mapped, count(*) FILTER (outcome = 'misplaced') AS n_wrong FROM scored WHERE outcome <> 'unmapped' GROUP BY ALL",
    "labelled": "SELECT s.*, p.label AS ptype, p.cover AS ptype_cover, c.label AS conf, c.cover AS conf_cover FROM scored s JOIN labels2 p ON p.rid = s.rid AND p.set_name = 'ptype' JOIN labels2 c ON c.rid = s.rid AND c.set_name = 'conf'",
    "strata": """SELECT aligner, stratum_set, stratum, count(*) AS n, count(*) FILTER (outcome = 'correct') AS n_correct, count(*) FILTER (outcome = 'misplaced') AS n_misplaced,
      count(*) FILTER (outcome = 'unmapped') AS n_unmapped, count(*) FILTER (outcome <> 'unmapped' AND mapq >= 30) AS n_confident, count(*) FILTER (outcome = 'misplaced' AND mapq >= 30) AS n_confident_wrong
      FROM (UNPIVOT (SELECT aligner, outcome, mapq, ptype, ptype_cover, conf, conf_cover FROM labelled) ON ptype, ptype_cover, conf, conf_cover INTO NAME stratum_set VALUE stratum) GROUP BY ALL""",
    "agree": """SELECT a.qname, a.mate, a.place, a.aligner, b.place AS other, a.mapped AND b.mapped AND a.contig = b.contig
        AND greatest(0, least(a.end0, b.end0) - greatest(a.start0, b.start0))::DOUBLE / (greatest(a.end0, b.end0) - least(a.start0, b.start0)) > 0.1::DOUBLE AS ok
      FROM placements a JOIN placements b ON a.qname = b.qname AND a.mate = b.mate""",
    "best": "SELECT * FROM (SELECT qname, mate, place, count(*) FILTER (ok) AS support FROM agree GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY qname, mate ORDER BY support DESC, place) = 1",
    "majority": """SELECT b.qname, b.mate, b.support >= 3 AS has_consensus, b.support, CASE WHEN b.support >= 3 THEN p.contig ELSE '' END AS contig,
        CASE WHEN b.support >= 3 THEN p.start0 ELSE 0 END AS start0, CASE WHEN b.support >= 3 THEN p.end0 ELSE 0 END AS end0, """
    + ", ".join(
        f"coalesce((SELECT CASE WHEN NOT x.mapped THEN 'unmapped' WHEN g.ok THEN 'agree' ELSE 'disagree' END FROM aln{k} x JOIN agree g ON g.qname = x.qname AND g.mate = x.mate AND g.place = {k} AND g.other = b.place WHERE x.qname = b.qname AND x.mate = b.mate), 'unmapped') AS status_t{k}, "
        f"coalesce((SELECT x.mapq FROM aln{k} x WHERE x.qname = b.qname AND x.mate = b.mate), 0)::BIGINT AS mapq_t{k}"
        for k in range(4)
    )
    + " FROM best b JOIN placements p ON p.qname = b.qname AND p.mate = b.mate AND p.place = b.place",
}


def oracle(body: str, *names: str) -> str:
    """SQL text with the named tables, and those they use, in front."""
    used, todo = set(), [*names]
    while todo:
        name = todo.pop()
        if name not in used:
            used.add(name)
            todo += [other for other in CTES if other != name and f" {other}" in CTES[name] and any(f"{w} {other}" in CTES[name] for w in ("FROM", "JOIN"))]
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in CTES.items() if name in used) + "\n" + body


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded and integers widened, for comparison with another engine."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "double":
            out[name] = F.round(F.col(name), places)
        elif kind in ("int", "smallint", "tinyint"):
            out[name] = F.col(name).cast("long")
    return df.withColumns(out) if out else df
