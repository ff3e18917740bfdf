"""Text formats as relational round trips: FASTA, GFF3 and event tables."""

from __future__ import annotations

from tessera.plans.operator import SparkDialect, operator, view


@view("letters", "sites")
def _(d: SparkDialect) -> str:
    return f"""SELECT seq_id, {d.joined("substr('ACGTN', base + 1, 1)", 'site')} AS sequence FROM sites GROUP BY seq_id"""


@view("fasta", "letters")
def _(d: SparkDialect) -> str:
    """One record a row: a header and lines of 80."""
    text, eighty = ("STRING" if d.name == "spark" else "VARCHAR"), "(" + "." * 80 + ")"
    wrapped = f"regexp_replace(sequence, '{eighty}', concat('$1', chr(10)))" if d.name == "spark" else f"regexp_replace(sequence, '{eighty}', concat(chr(92), '1', chr(10)), 'g')"
    return f"SELECT seq_id, concat('>nation_', CAST(seq_id AS {text}), chr(10), {wrapped}) AS record FROM letters"


@operator("fasta_export", "fasta")
def _(d: SparkDialect) -> str:
    """Sequences as FASTA records."""
    return "SELECT seq_id, record FROM fasta"


@operator("fasta_roundtrip", "fasta")
def _(d: SparkDialect) -> str:
    """Records read back: the name after the bracket, and the lines below without breaks."""
    return f"SELECT substr(record, 2, strpos_ - 2) AS name, translate(substr(record, strpos_ + 1), chr(10), '') AS sequence FROM (SELECT record, instr(record, chr(10)) AS strpos_ FROM fasta) x"


@operator("sequence_cleaning", "letters")
def _(d: SparkDialect) -> str:
    """Upper case, no white space, U to T, and whether the alphabet is valid."""
    return f"SELECT seq_id, replace(upper(dirty), 'U', 'T') AS cleaned, {d.matches(chr(39).join(['replace(upper(dirty), ', 'U', ', ', 'T', ')']), '^[ACGTRYSWKMBDHVN?.*-]+$')} AS valid FROM (SELECT seq_id, lower(translate(sequence, 'T', 'U')) AS dirty FROM letters) x"


@operator("unique_names", "supplier")
def _(d: SparkDialect) -> str:
    """Names made distinct: the second and later of equal names get a suffix."""
    text = "STRING" if d.name == "spark" else "VARCHAR"
    return f"SELECT s_suppkey, CASE WHEN k = 1 THEN base ELSE concat(base, '_', CAST(k AS {text})) END AS name FROM (SELECT s_suppkey, base, row_number() OVER (PARTITION BY base ORDER BY s_suppkey) AS k FROM (SELECT s_suppkey, concat('nation_', CAST(s_nationkey AS {text})) AS base FROM supplier) b) r"


@operator("reference_group", "supplier")
def _(d: SparkDialect) -> str:
    """The group of a sequence: its name without trailing digits and separators."""
    return f"SELECT s_suppkey, {d.replace_all('s_name', '[-_.# 0-9]+$', '')} AS reference_group FROM supplier"


@operator("gff_roundtrip", "best_events")
def _(d: SparkDialect) -> str:
    """Tracts as GFF3 lines (1-based, closed) and read back (0-based, half open)."""
    t = "STRING" if d.name == "spark" else "VARCHAR"
    line = f"concat('nation_', CAST(recombinant AS {t}), chr(9), 'tessera', chr(9), 'recombination', chr(9), CAST(tract_start + 1 AS {t}), chr(9), CAST(tract_end AS {t}), chr(9), '.', chr(9), '+', chr(9), '.', chr(9), 'ID=', event_id, ';minor=', CAST(minor AS {t}))"
    field = lambda k: f"split_part(line, chr(9), {k})"
    return f"SELECT line, CAST({field(4)} AS INT) - 1 AS feature_start, CAST({field(5)} AS INT) AS feature_end, split_part(split_part({field(9)}, ';', 1), '=', 2) AS id FROM (SELECT {line} AS line FROM best_events) x"


@operator("event_csv", "best_events")
def _(d: SparkDialect) -> str:
    """Events as quoted cells with one-based starts."""
    t = "STRING" if d.name == "spark" else "VARCHAR"
    q = "chr(34)"
    cells = ", ',', ".join(f"{q}, {x}, {q}" for x in ("event_id", f"CAST(recombinant AS {t})", f"CAST(major AS {t})", f"CAST(minor AS {t})", f"CAST(tract_start + 1 AS {t})", f"CAST(tract_end AS {t})"))
    return f"SELECT event_id, concat({cells}) AS line FROM best_events"
