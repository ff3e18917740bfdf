"""Alignment and annotation files as DataFrames.

``files`` reads whole texts as (path, text); each reader takes such rows, explodes them to numbered lines and puts
records together with windows and grouped lists by file, so many files are read side by side.  Nothing is
parsed row by row in Python.  A malformed file raises the error that names what is missing in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

SEQUENCE = r"[A-Za-z?.!*\-]+"
SPACED = r"[A-Za-z?.!*\-\s]+"
NAMING = ("label", "gene", "product", "locus_tag")
FEATURES = ("path", "id", "type", "feature_start", "feature_end", "strand", "phase", "name", "source", "attributes")


def by_line() -> WindowSpec:
    return Window.partitionBy("path").orderBy("line_no")


def before() -> WindowSpec:
    return by_line().rowsBetween(Window.unboundedPreceding, -1)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def lines(texts: DataFrame, text: str | Column = "text") -> DataFrame:
    return texts.select("path", F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def _records(chunks: DataFrame) -> DataFrame:
    """path, position, name and sequence from (path, line_no, name, chunk): chunks of a name in the order of their lines."""
    whole = F.expr("array_join(transform(array_sort(collect_list(struct(line_no, chunk))), x -> x.chunk), '')")
    found = chunks.groupBy("path", "name").agg(F.min("line_no").alias("first"), whole.alias("sequence"))
    return found.select("path", F.row_number().over(Window.partitionBy("path").orderBy("first")).alias("position"), "name", "sequence")


def _must(ok: Column, message: str) -> Column:
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def fasta(texts: DataFrame) -> DataFrame:
    """Headers start with a bracket, comments with a semicolon; lines of a record are joined.  Records of equal names stay apart."""
    rows = lines(texts).withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, ';')")
    rows = rows.withColumn("record", F.sum(F.col("line").startswith(">").cast("int")).over(by_line()))
    rows = rows.where(_must(F.col("record") > 0, "FASTA data before the first header"))
    body = F.expr("array_join(transform(array_sort(collect_list(if(startswith(line, '>'), null, struct(line_no, line)))), x -> x.line), '')")
    return rows.groupBy("path", "record").agg(F.min_by(F.trim(F.substring("line", 2, 1 << 30)), "line_no").alias("name"), body.alias("sequence")).select("path", F.col("record").cast("int").alias("position"), "name", "sequence")


def clustal(texts: DataFrame) -> DataFrame:
    """The first line, blank lines and indented lines are skipped; a count may follow a chunk."""
    pattern = rf"^(\S+)\s+({SEQUENCE})(?:\s+\d+)?\s*$"
    rows = lines(texts).where((F.col("line_no") > 0) & F.col("line").rlike(pattern))
    return _records(rows.select("path", "line_no", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("chunk")))


def nexus(texts: DataFrame) -> DataFrame:
    """The lines between ``matrix`` and the next semicolon, without bracketed comments; names may be quoted."""
    block = F.regexp_extract("text", r"(?is)\bmatrix\b(.*?);", 1)
    pattern = rf"""^(?:'([^']+)'|"([^"]+)"|(\S+))\s+({SPACED})$"""
    rows = lines(texts.where(_must(F.col("text").rlike(r"(?is)\bmatrix\b.*?;"), "no MATRIX block in the NEXUS file")), block)
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", r"\[[^\]]*\]", ""))).where(F.col("line").rlike(pattern))
    name = F.concat(*(F.regexp_extract("line", pattern, k) for k in (1, 2, 3)))
    return _records(rows.select("path", "line_no", name.alias("name"), F.regexp_replace(F.regexp_extract("line", pattern, 4), r"\s", "").alias("chunk")))


def phylip(texts: DataFrame) -> DataFrame:
    """A header with the counts, then named lines; lines without a new name go on with the names in turn."""
    pattern = rf"^(\S+)\s+({SPACED})$"
    rows = lines(texts).withColumn("line", F.trim("line")).where("line <> ''").withColumn("line_no", F.row_number().over(by_line()))
    head = rows.where("line_no = 1").where(_must(F.col("line").rlike(r"^\d+\s+\d+"), "no counts in the PHYLIP header"))
    expected = head.select("path", F.regexp_extract("line", r"^(\d+)", 1).cast("int").alias("expected"))
    rows = rows.where("line_no > 1").join(expected, "path").withColumn("label", F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)))
    new = F.col("label").isNotNull() & (F.row_number().over(Window.partitionBy("path", "label").orderBy("line_no")) == 1)
    rows = rows.withColumn("new", new.cast("int")).withColumn("known", F.coalesce(F.sum("new").over(before()), F.lit(0)))
    rows = rows.withColumn("named", F.col("label").isNotNull() & ((F.col("new") == 1) | (F.col("known") < F.col("expected"))))
    further = (~F.col("named") & (F.col("known") > 0)).cast("int")
    rows = rows.withColumn("turn", F.coalesce(F.sum(further).over(before()), F.lit(0)))
    order = rows.where("new = 1").select("path", (F.col("known")).alias("slot"), F.col("label").alias("slot_name"))
    rows = rows.withColumn("slot", F.when(~F.col("named") & (F.col("known") > 0), F.col("turn") % F.col("known")))
    rows = rows.join(order, ["path", "slot"], "left").withColumn("name", F.when(F.col("named"), F.col("label")).otherwise(F.col("slot_name"))).where("name is not null")
    chunk = F.regexp_replace(F.when(F.col("named"), F.regexp_extract("line", pattern, 2)).otherwise(F.col("line")), r"\s", "")
    records = _records(rows.select("path", "line_no", "name", chunk.alias("chunk"))).join(expected, "path")
    fits = F.count(F.lit(1)).over(Window.partitionBy("path")) == F.col("expected")
    return records.withColumn("fits", fits).where(_must(F.col("fits"), "the PHYLIP header names another number of sequences")).drop("expected", "fits")


FORMATS = {"fasta": fasta, "clustal": clustal, "nexus": nexus, "phylip": phylip}


def sniff(text: str | Column = "text") -> Column:
    """The format of a text by its first characters; null for any other."""
    t = F.ltrim(F.col(text) if isinstance(text, str) else text)
    return F.when(t.startswith(">"), "fasta").when(t.rlike(r"^(?i)(CLUSTAL|MUSCLE)"), "clustal").when(t.rlike(r"^(?i)#NEXUS"), "nexus").when(t.rlike(r"^\d+[ \t]+\d+"), "phylip")


def alignment(texts: DataFrame) -> DataFrame:
    """Records of files of any of the formats.  Each text is read by one branch; a text of no format raises an error."""
    known = texts.withColumn("format", sniff())
    # the condition looks at the text, so that it stays above whatever made the text
    out = known.where(F.when(F.col("format").isNull(), F.raise_error(F.lit("unknown alignment format")).cast("boolean")).otherwise(F.lit(False)))
    out = out.select("path", F.lit(0).alias("position"), F.col("text").alias("name"), F.col("text").alias("sequence"))
    for name, reader in FORMATS.items():
        part = reader(known.where(F.col("format") == name).select("path", "text"))
        out = out.unionByName(part)
    return out


def finalize(records: DataFrame) -> DataFrame:
    """Cleaned records with unique names: upper case, no white space, U to T; a file needs three sequences of one length over the alphabet.

    Blank names become Sequence_i; later ones of equal names get a number."""
    clean = records.withColumn("sequence", F.translate(F.upper(F.regexp_replace("sequence", r"\s", "")), "U", "T")).where("sequence <> ''")
    of_file = Window.partitionBy("path")
    clean = clean.where(_must(F.col("sequence").rlike(r"^[ACGTRYSWKMBDHVN?.!*\-]+$"), "a sequence has characters outside the alphabet"))
    clean = clean.withColumns({"n": F.count(F.lit(1)).over(of_file), "low": F.min(F.length("sequence")).over(of_file), "high": F.max(F.length("sequence")).over(of_file)})
    clean = clean.where(_must(F.col("n") >= 3, "an alignment needs three sequences")).where(_must(F.col("low") == F.col("high"), "the sequences differ in length"))
    base = F.when(F.trim("name") == "", F.concat(F.lit("Sequence_"), F.col("position"))).otherwise(F.trim("name"))
    again = F.row_number().over(Window.partitionBy("path", "base").orderBy("position"))
    named = clean.withColumn("base", base).withColumn("again", again)
    return named.select("path", "position", F.when(F.col("again") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), "again")).alias("name"), "sequence")


def sites(records: DataFrame) -> DataFrame:
    """(path, seq_id, site, base) of finalized records: A C G T are 0 to 3, gaps 5, all else 4."""
    letter = F.col("letter")
    code = F.when(letter.isin("-", "."), 5).when(letter == "A", 0).when(letter == "C", 1).when(letter == "G", 2).when(letter == "T", 3).otherwise(4)
    return records.select("path", (F.col("position") - 1).cast("long").alias("seq_id"), F.posexplode(F.split("sequence", "")).alias("site", "letter")).where("letter <> ''").select("path", "seq_id", "site", code.cast("int").alias("base"))


def _decoded(x: Column) -> Column:
    """Percent-decoding, in which a plus sign stays one."""
    return F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def gff3(texts: DataFrame, length: int) -> DataFrame:
    """Lines of eight tab-separated columns or more; one-based closed coordinates become zero-based half-open ones."""
    rows = lines(texts).where("line <> '' and not startswith(line, '#')").withColumn("c", F.split("line", "\t")).where("size(c) >= 8")
    rows = rows.withColumns({"feature_start": F.greatest(F.lit(0), F.expr("try_cast(c[3] as int)") - 1), "feature_end": F.least(F.lit(length), F.expr("try_cast(c[4] as int)"))})
    rows = rows.where("try_cast(c[3] as int) is not null and try_cast(c[4] as int) is not null and feature_end > feature_start").withColumn("k", F.row_number().over(by_line()))
    pairs = F.filter(F.transform(F.split(F.coalesce(F.get("c", F.lit(8)), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: ~x.startswith("=") & (x != ""))
    entry = lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("key"), _decoded(F.when(F.instr(x, "=") > 0, F.substr(x, F.instr(x, "=") + 1)).otherwise("")).alias("value"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.lit(0), F.size(entries) - i - 1)), lambda y: y["key"] == x["key"]))
    rows = rows.withColumn("attributes", F.map_from_entries(last))
    got = lambda key: F.nullif(F.try_element_at("attributes", F.lit(key)), F.lit(""))
    c = lambda i: F.col("c")[i]
    return rows.select(
        "path", F.coalesce(got("ID"), F.concat("path", F.lit("-"), "k")).alias("id"), F.coalesce(F.nullif(c(2), F.lit("")), F.lit("feature")).alias("type"), "feature_start", "feature_end",
        F.when(c(6).isin("+", "-"), c(6)).otherwise(".").alias("strand"), F.when(c(7).isin("0", "1", "2"), c(7).cast("int")).alias("phase"),
        F.coalesce(got("Name"), got("gene"), got("product"), got("ID"), F.concat(c(2), F.lit(" "), "k")).alias("name"), F.coalesce(F.nullif(c(1), F.lit("")), "path").alias("source"), "attributes",
    )


def genbank(texts: DataFrame, length: int) -> DataFrame:
    """The feature table: from the smallest to the largest coordinate of a location; qualifiers below belong to it, the last of a name counts."""
    place, qualifier = r"^\s{5}(\S+)\s+(.+)$", r'^\s+/(\w+)=(?:"([^"]*)"|(\S+))'
    rows = lines(texts).withColumn("spot", F.when(F.col("line").rlike(place), F.regexp_extract("line", place, 2)))
    numbers = F.transform(F.regexp_extract_all("spot", F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    rows = rows.withColumns({"feature_start": F.greatest(F.lit(0), F.array_min(numbers) - 1), "feature_end": F.least(F.lit(length), F.array_max(numbers))})
    rows = rows.withColumn("is_feature", F.coalesce(F.col("feature_end") > F.col("feature_start"), F.lit(False)) & F.coalesce(F.size(numbers) > 0, F.lit(False)))
    rows = rows.withColumn("k", F.sum(F.col("is_feature").cast("int")).over(by_line())).where("k > 0")
    rows = rows.withColumn("key", F.when(F.col("spot").isNull() & F.col("line").rlike(qualifier), F.regexp_extract("line", qualifier, 1)))
    rows = rows.withColumn("value", F.concat(F.regexp_extract("line", qualifier, 2), F.regexp_extract("line", qualifier, 3)))
    heads = rows.where("is_feature").select("path", "k", F.regexp_extract("line", place, 1).alias("type"), F.trim("spot").alias("location"), "feature_start", "feature_end")
    told = rows.where("key is not null")
    last = told.groupBy("path", "k", "key").agg(F.max_by("value", "line_no").alias("value")).groupBy("path", "k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("told"))
    names = told.where(F.col("key").isin(*NAMING)).groupBy("path", "k").agg(F.max_by("value", "line_no").alias("named"))
    out = heads.join(last, ["path", "k"], "left").join(names, ["path", "k"], "left")
    with_place = F.map_concat(F.create_map(F.lit("location"), F.col("location")), F.coalesce(F.map_filter("told", lambda key, _: key != "location"), F.create_map().cast("map<string,string>")))
    return out.select("path", F.concat("path", F.lit("-"), "k").alias("id"), "type", "feature_start", "feature_end", F.when(F.lower("location").contains("complement("), "-").otherwise("+").alias("strand"), F.lit(None).cast("int").alias("phase"), F.coalesce("named", F.concat("type", F.lit(" "), "k")).alias("name"), F.col("path").alias("source"), with_place.alias("attributes"))


def bed(texts: DataFrame, length: int) -> DataFrame:
    """Columns by white space: sequence, start, end, name, type, strand; zero-based half-open."""
    rows = lines(texts).where("line <> '' and not startswith(line, '#')").withColumn("c", F.split("line", r"\s+")).where("size(c) >= 3")
    rows = rows.withColumns({"feature_start": F.greatest(F.lit(0), F.expr("try_cast(c[1] as int)")), "feature_end": F.least(F.lit(length), F.expr("try_cast(c[2] as int)"))})
    rows = rows.where("try_cast(c[1] as int) is not null and try_cast(c[2] as int) is not null and feature_end > feature_start").withColumn("k", F.row_number().over(by_line()))
    c = lambda i: F.nullif(F.get("c", F.lit(i)), F.lit(""))
    return rows.select("path", F.concat("path", F.lit("-"), "k").alias("id"), F.coalesce(c(4), F.lit("region")).alias("type"), "feature_start", "feature_end", F.when(c(5).isin("+", "-"), c(5)).otherwise(".").alias("strand"), F.lit(None).cast("int").alias("phase"), F.coalesce(c(3), F.concat(F.lit("region "), "k")).alias("name"), F.col("path").alias("source"), F.create_map().cast("map<string,string>").alias("attributes"))


def annotations(texts: DataFrame, length: int) -> DataFrame:
    """Features of files in GFF3, GenBank or BED; the format is taken from the text."""
    kind = F.when(F.exists(F.split("text", r"\r?\n"), lambda x: F.size(F.split(x, "\t")) >= 8), "gff3").when(F.col("text").rlike(r"(?m)^\s*FEATURES\s+Location/Qualifiers"), "genbank").otherwise("bed")
    known = texts.withColumn("kind", kind)
    parts = [reader(known.where(F.col("kind") == name).select("path", "text"), length).select(*FEATURES) for name, reader in (("gff3", gff3), ("genbank", genbank), ("bed", bed))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
