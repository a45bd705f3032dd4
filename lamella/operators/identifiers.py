"""Identifiers and labels read out of names, paths and columns: exact rules, in a stated order, null where none holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.text import normalise
from lamella.plans import made, made_sql

#: Fixed value: how a donor's identifier is written.
DONOR = r"H\d{2}\.\d{2}\.\d{3}"
#: Ending or part of a lower-cased file name -> role, in this order. The second list is the variant
#: without the manifest rule, whose images come after pages.
SECTION_ROLES = (
    (r"\.h5ad$", "merged_or_annotated_h5ad"), (r"^(?=.*cellpose)(?=.*transcript).*\.csv$", "cellpose_detected_transcripts"), (r"detected_transcripts.*\.csv$", "detected_transcripts"),
    (r"dapi.*\.tiff?$", "dapi_image"), (r"polyt.*\.tiff?$", "polyt_image"), ("manifest", "manifest"), (r"\.csv$", "csv_other"), (r"\.json$", "json_other"), (r"\.tiff?$", "image_other"), (r"\.html$", "html"),
)
SPATIAL_ROLES = (*SECTION_ROLES[:5], *SECTION_ROLES[6:8], SECTION_ROLES[9], SECTION_ROLES[8])
#: Part of an object's key -> assay, and part of its key or file name -> family, in this order.
ASSAYS = (("/RNAseq/", "snRNAseq"), ("/ATACseq/", "snATACseq"))
FAMILIES = (
    ("donors_objects/", "per-donor region object"), ("pseudobulk_objects/", "pseudobulk (donor x region x supertype)"), ("subclass_objects/", "multiregion subclass object"),
    ("pertpy_compositional_modeling/", "compositional model output"), ("gpboost_differential", "differential-expression model output"), ("supertype_annotation/|subclass_annotation/", "taxonomy mapping output"),
    ("final_embeddings/", "integrated latent representation"), ("continuous_pseudo-progression_score/", "published pseudo-progression score"),
)
FILE_FAMILIES = ((r"metadata\.", "per-nucleus metadata table"), ("cell-annotation", "per-nucleus annotation table"), (r"\.h5ad$|\.rds$", "region-level AnnData"))
#: Pattern of a column's name -> metric and unit, in this order.
METRICS = (
    ("area analyzed$", "denominator: tissue area analysed", "um^2"), ("per tissue area|per_tissue_area", "density (per analysed area)", "count per um^2"),
    ("^percent of .*(colocalized|co-localized)", "colocalization fraction", "% of objects"), ("^percent .*(plaque|positive) area$", "positive area fraction", "% of analysed area"),
    ("^percent .*co-expression", "co-expression fraction", "%"), ("^number of .* per area$", "density (per analysed area)", "count per um^2"),
    ("^number of .*(colocalized|co-localized)", "colocalized object count", "count"), ("^number of ", "raw count", "count"), ("process length per cell$", "per-cell process length", "um per cell"),
    ("process area per cell$", "per-cell process area", "um^2 per cell"), ("median diameter$", "mean object diameter", "um"), ("roundness$", "mean object roundness", "unitless"),
    ("perimeter$", "mean object perimeter", "um"), ("^average .* area$", "mean object area", "um^2"), ("^average .* length$", "mean branch/process length", "um"),
    ("^total .* length$", "total process length", "um"), ("^total .* area$", "total positive area", "um^2"), ("^(ripa|guhcl) ", "Luminex biochemical measure", None),
)
UNKNOWN_METRIC = "unclassified - needs review"
REGION_SUFFIX = "_(Grey matter|Layer[0-9](-[0-9])?)$"
#: Marker -> pattern of the columns that hold it, in either case.
MARKERS = {"Ab (6E10)": "6e10", "pTau (AT8)": r"\bAT8\b", "NeuN": "NeuN", "IBA1": "Iba1", "GFAP": "GFAP", "pTDP-43": "pTDP43", "a-synuclein": "aSyn", "Hematoxylin": "Hematoxylin"}
#: Pattern of a level -> what it says of the grain, in this order.
GRAINS = (("^Grey matter$", "whole-region grey matter"), ("^Layer", "cortical layer"), ("^(CA[1-4]|DG|Sub)", "hippocampal subfield"), ("^(EC|TEC)", "entorhinal subregion"), ("-(L|R)$", "hemisphere-resolved"))
#: Spellings in file names that no rule gives.
IRREGULAR = {"L23-IT": "L2/3 IT", "L56-NP": "L5/6 NP", "VLMC-Perivascular": "VLMC & Perivascular"}
#: Roman numerals of layers, and the layers there are.
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "V-VI": "5-6"}
LAYERS = ("L1", "L2", "L3", "L4", "L5", "L6", "L5-6")
BYTES_PER_GB = 1024**3
ID_WORDS = ("donor", "barcode", "specimen", "section", "sample", "id")


def tokens(path: Column) -> Column:
    """The parts of a path between slashes, empty ones left out."""
    return F.filter(F.split(path, "/"), lambda t: t != "")


def donor_in(parts: Column) -> Column:
    """The first part that is a donor's identifier as a whole."""
    return F.try_element_at(F.filter(parts, lambda t: t.rlike(f"^{DONOR}$")), F.lit(1))


def after(parts: Column, mark: Column) -> Column:
    """The part after the first one that equals mark; null where that is the last or there is none."""
    at = F.array_position(parts, mark)
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))


def stain_and_block(folder: Column, donor: Column) -> tuple[Column, Column]:
    """Of donor-block-stain: the last part, and all before it; null with fewer than two parts."""
    rest = F.when(F.startswith(folder, F.concat(donor, F.lit("-"))), F.expr("1")).isNotNull()
    code = F.when(rest, F.substr(folder, F.length(donor) + 2)).otherwise(folder)
    parts = F.split(code, "-")
    several = donor.isNotNull() & (F.size(parts) >= 2)
    return F.when(several, F.element_at(parts, -1)), F.when(several, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "-"))


def first_match(text: Column, rules: tuple, other: str | None, place: int = 1, lower: bool = False) -> Column:
    """What the first rule says whose pattern text holds."""
    out = F.lit(other)
    for rule in reversed(rules):
        out = F.when((F.lower(text) if lower else text).rlike(rule[0]), F.lit(rule[place])).otherwise(out)
    return out


def gigabytes(size: Column) -> Column:
    """Three digits, ties of the binary quotient to the even digit."""
    return F.bround(size / F.lit(float(BYTES_PER_GB)), 3)


def object_manifest(objects: DataFrame, key: str, size: str, release: str = "[A-Z]+") -> DataFrame:
    """objects with folder, file, size in MB, assay, region, donor, date, nuclei set and family; a region stands between
    the release's name (a pattern) and the assay."""
    k = F.col(key)
    file = F.regexp_extract(k, "([^/]*)$", 1)
    found = lambda text, pattern, group=0: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    family = F.coalesce(first_match(k, FAMILIES, None), first_match(file, FILE_FAMILIES, "other"))
    return objects.select(
        key, found(k, "^([^/]+)/", 1).alias("folder"), file.alias("file"), F.round(F.col(size) / 1e6, 6).alias("size_mb"), first_match(k, ASSAYS, "multiregion/model output").alias("assay"),
        found(file, f"{release}_([A-Za-z0-9]+)_(?:RNAseq|ATACseq)", 1).alias("region"), found(file, f"^{DONOR}").alias("donor"), found(file, r"\d{4}-\d{2}-\d{2}").alias("release_date"),
        first_match(file, (("all-nuclei", "all-nuclei"), ("final-nuclei", "final-nuclei")), None).alias("nuclei_set"), family.alias("family"),
    )


def scoring_domain(lineage: Column, kind: Column) -> Column:
    """The lineage, but for immune kinds: the resident family by its prefix, two kinds as they are, others fail."""
    unknown = F.raise_error(F.concat(F.lit("unmapped immune kind: "), F.coalesce(kind, F.lit("(none)")))).cast("string")
    return F.when(lineage != "Immune", lineage).when(F.startswith(kind, F.lit("Micro-PVM")), "Micro/PVM").when(kind.isin("Lymphocyte", "Monocyte"), kind).otherwise(unknown)


def lineage_of(kind: Column, subclass: Column, class_: Column) -> Column:
    return (
        F.when(F.startswith(kind, F.lit("Micro-PVM")), "microglia_PVM").when(kind.isin("Lymphocyte", "Monocyte"), "other_immune").when(subclass == "Astrocyte", "astrocyte")
        .when(subclass == "Oligodendrocyte", "oligodendrocyte").when(subclass == "OPC", "OPC").when(F.startswith(class_, F.lit("Neuronal")), "neuron").otherwise("other_non_neural")
    )


def metric_family(name: Column) -> tuple[Column, Column, Column]:
    """(metric, unit, the region that the name ends with) of a column's name."""
    base = F.regexp_replace(name, REGION_SUFFIX, "")
    suffix = F.nullif(F.regexp_extract(name, REGION_SUFFIX, 1), F.lit(""))
    rules = tuple((f"(?i){p}", m, u) for p, m, u in METRICS)
    return first_match(base, rules, UNKNOWN_METRIC), first_match(base, rules, None, 2), suffix


def marker_columns(names: DataFrame, column: str, markers: dict[str, str] = MARKERS) -> DataFrame:
    """(column, marker, n_markers, is_colocalization): a row for each marker that a column's name holds."""
    hits = F.filter(F.array(*(F.when(F.col(column).rlike(f"(?i){p}"), F.lit(m)) for m, p in markers.items())), lambda m: m.isNotNull())
    found = names.select(column).distinct().withColumn("hits", hits)
    return found.select(column, F.explode("hits").alias("marker"), F.size("hits").alias("n_markers"), (F.size("hits") > 1).alias("is_colocalization"))


def resolution_label(rows: DataFrame, group: str, level: str) -> DataFrame:
    """What the levels of a group say together of its grain, joined in a fixed order."""
    flags = [F.max(F.when(F.col(level).rlike(p), F.lit(say))).alias(f"f{i}") for i, (p, say) in enumerate(GRAINS)]
    own = rows.groupBy(group).agg(*flags, F.array_sort(F.collect_set(level)).alias("levels"))
    said = F.concat_ws(" + ", *(F.col(f"f{i}") for i in range(len(GRAINS))))
    return own.select(group, F.when(F.size("levels") == 0, "not stated in sheet").when(said == "", F.concat(F.lit("other: "), F.array_join("levels", ", "))).otherwise(said).alias("resolution"))


def subclass_of(files: DataFrame, token: str, known: DataFrame, name: str) -> DataFrame:
    """files with the subclass that a file name's token stands for: irregular, exact, or with blanks for dashes."""
    irregular = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    names = known.select(F.col(name).alias("_n")).distinct()
    as_is, spaced = names.withColumnRenamed("_n", "_a"), names.withColumnRenamed("_n", "_b")
    joined = files.join(as_is, F.col(token) == F.col("_a"), "left").join(spaced, F.replace(F.col(token), F.lit("-"), F.lit(" ")) == F.col("_b"), "left")
    return joined.withColumn("subclass", F.coalesce(F.try_element_at(irregular, F.col(token)), "_a", "_b")).drop("_a", "_b")


def canonical_layer(name: Column) -> Column:
    """A layer's name in Arabic numerals, however it is written; null for no layer."""
    rest = F.upper(F.replace(F.regexp_replace(F.trim(name), r"(?i)^\s*layer\s*", ""), F.lit(" "), F.lit("")))
    roman = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    out = F.concat(F.lit("L"), F.coalesce(F.try_element_at(roman, rest), rest))
    return F.when(out.isin(*LAYERS), out)


def identifier_columns(rows: DataFrame, columns: list[str], words: tuple[str, ...] = ID_WORDS) -> DataFrame:
    """(column, by_name, by_values): columns whose name says identifier, or whose values look like ones: 5 % or more
    distinct and over 1 % long numbers or over 1 % donors."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), normalise(F.col(c)).alias("value")) for c in columns))).alias("x")).select("x.*").where("value IS NOT NULL")
    share = lambda p: F.avg(F.when(F.col("value").rlike(p), 1.0).otherwise(0.0))
    stats = each.groupBy("column").agg((F.countDistinct("value") / F.count("*")).alias("u"), share(r"^\d{6,}$").alias("long"), share(DONOR).alias("donor"))
    by_name = F.col("column").rlike("(?i)" + "|".join(words))
    return stats.select("column", by_name.alias("by_name"), ((F.col("u") >= 0.05) & ((F.col("long") > 0.01) | (F.col("donor") > 0.01))).alias("by_values"))


def donor_column(rows: DataFrame, preferred: tuple[str, ...] = ("Donor ID", "donor_id")) -> str | None:
    """The first preferred name in the order of columns, else the first column with any value that is a donor."""
    for c in rows.columns:
        if c in preferred:
            return c
    held = rows.agg(*(F.max(F.trim(F.col(f"`{c}`").cast("string")).rlike(f"^{DONOR}$")).alias(str(i)) for i, c in enumerate(rows.columns))).first()
    return next((c for i, c in enumerate(rows.columns) if held[i]), None)


def present(rows: DataFrame, names: list[str]) -> str | None:
    """The first of names that is a column."""
    return next((n for n in names if n in rows.columns), None)


def coordinate_columns(rows: DataFrame, pairs: tuple = (("x", "y"), ("X", "Y"), ("center_x", "center_y")), pattern: str = r"(^|_)(x|y|z|coord|spatial|centroid)(_|\d|$)", most: int = 12) -> list[str]:
    """The first pair that is there, else up to most numeric columns whose names look like coordinates."""
    import re

    if found := next((p for p in pairs if set(p) <= set(rows.columns)), None):
        return list(found)
    return [n for n, t in rows.dtypes if t in ("int", "bigint", "float", "double") and re.search(pattern, n.lower())][:most]


def download_plan(wanted: DataFrame, listed: DataFrame, prefix: str, suffix: str, most: int = 10, largest: int = 1_000_000_000) -> DataFrame:
    """(key, size, decision): whether each wanted object may be fetched, or the first rule that says no: at most `most`
    wanted, a key once, prefix and suffix, no way out of the folder, exactly one listed object, its size equal and not
    above largest."""
    seen = listed.groupBy("key").agg(F.count("*").alias("copies"), F.max("size").alias("there"))
    # the wanted list is short by the first rule, which is told before all others
    n = wanted.agg(F.count("*").alias("n"))
    own = wanted.withColumn("again", F.count("*").over(Window.partitionBy("key"))).join(seen, "key", "left").crossJoin(n)
    rules = [
        (F.col("n") > most, "too many items"), (F.col("again") > 1, "key repeated"), (~F.startswith("key", F.lit(prefix)), "wrong prefix"), (~F.endswith("key", F.lit(suffix)), "wrong suffix"),
        (F.col("key").rlike(r"(^|/)\.\.(/|$)|^/"), "path leaves the folder"), (F.coalesce("copies", F.lit(0)) != 1, "not exactly one listed object"), (F.col("size") != F.col("there"), "size differs"), (F.col("size") > largest, "too large"),
    ]
    decision = F.lit("fetch")
    for bad, say in reversed(rules):
        decision = F.when(bad, say).otherwise(decision)
    return own.select("key", "size", decision.alias("decision"))


_KEYS = {
    "id": "o_orderkey",
    "key": "CASE o_orderkey % 4 WHEN 0 THEN 'area//' ELSE '/area/' END || 'H' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || CASE o_orderkey % 7 WHEN 0 THEN '-33.001' ELSE '.33.001' END"
    " || CASE o_orderkey % 5 WHEN 0 THEN '' ELSE '/H' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || '.33.001-A' || CAST(o_orderkey % 9 AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '-S' || CAST(o_orderkey % 11 AS STRING) END || '/f.tif' END",
}
_OBJECTS = {
    "key": "CASE o_orderkey % 6 WHEN 0 THEN 'r/RNAseq/' WHEN 1 THEN 'r/ATACseq/donors_objects/' WHEN 2 THEN 'pseudobulk_objects/' WHEN 3 THEN 'x/final_embeddings/' WHEN 4 THEN 'a/' ELSE '' END"
    " || CASE o_custkey % 5 WHEN 0 THEN 'H' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || '.33.004_STUDY_MTG_RNAseq_all-nuclei.2024-02-1' || CAST(o_custkey % 9 AS STRING) || '.h5ad' WHEN 1 THEN 'STUDY_DLPFC_ATACseq_final-nuclei_metadata.csv' WHEN 2 THEN 'cell-annotation.rds' WHEN 3 THEN 'Manifest_detected_transcripts.csv' ELSE 'DAPI_Max.TIFF' END",
    "size": "o_orderkey * 1048576",
}
_NAMES = {
    "id": "p_partkey",
    "name": "CASE p_partkey % 9 WHEN 0 THEN 'percent AT8 positive area_Layer3' WHEN 1 THEN 'number of NeuN positive cells per area' WHEN 2 THEN 'Number of Iba1 6e10 colocalized objects' WHEN 3 THEN 'total aSyn area_Grey matter' WHEN 4 THEN 'average GFAP length'"
    " WHEN 5 THEN 'GuHCl ' || p_brand WHEN 6 THEN 'xAT8y roundness' WHEN 7 THEN p_name ELSE 'Number of ' || p_type END",
}
_LEVELS = {"g": "p_size", "level": "CASE p_partkey % 9 WHEN 0 THEN 'Grey matter' WHEN 1 THEN 'Layer' || CAST(p_size % 6 AS STRING) WHEN 2 THEN 'CA1' WHEN 3 THEN 'EC-L' WHEN 4 THEN NULL ELSE p_brand END"}
_KINDS = {"id": "p_partkey", "lineage": "CASE p_partkey % 3 WHEN 0 THEN 'Immune' ELSE p_brand END", "kind": "CASE p_size % 3 WHEN 0 THEN 'Micro-PVM_' || CAST(p_size AS STRING) WHEN 1 THEN 'Lymphocyte' ELSE 'Monocyte' END", "subclass": "CASE p_size % 4 WHEN 0 THEN 'Astrocyte' WHEN 1 THEN 'OPC' ELSE p_brand END", "class": "CASE p_size % 5 WHEN 0 THEN 'Neuronal: ' || p_brand ELSE 'x' END", "other": "CASE p_partkey % 2 WHEN 0 THEN p_brand ELSE CASE p_size % 3 WHEN 0 THEN 'Micro-PVM_' || CAST(p_size AS STRING) ELSE 'Monocyte' END END"}
_LAYER = {"id": "p_partkey", "name": "CASE p_partkey % 6 WHEN 0 THEN ' LAyerIII' WHEN 1 THEN 'Layer V-VI' WHEN 2 THEN 'layer ' || CAST(p_size % 9 AS STRING) WHEN 3 THEN 'iv' WHEN 4 THEN 'Layer5 - 6' ELSE p_brand END"}
_FILES = {"id": "p_partkey", "token": "CASE p_partkey % 4 WHEN 0 THEN 'L23-IT' WHEN 1 THEN replace(p_type, ' ', '-') WHEN 2 THEN p_brand ELSE p_name END"}
_PEOPLE = {"code": "CAST(100000 + c_custkey AS STRING)", "donor_label": "c_mktsegment", "free": "'H' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '.33.' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')", "segment": "c_mktsegment", "balance": "CAST(round(c_acctbal) AS STRING)"}


def _q_paths(s, d):
    parts = made(s, d, "orders", _KEYS).withColumn("t", tokens(F.col("key"))).withColumn("donor", donor_in(F.col("t"))).withColumn("section", after(F.col("t"), F.col("donor")))
    stain, block = stain_and_block(F.col("section"), F.col("donor"))
    return parts.select("id", F.size("t").alias("n_tokens"), "donor", "section", stain.alias("stain"), block.alias("block"))


def _q_metrics(s, d):
    metric, unit, region = metric_family(F.col("name"))
    return made(s, d, "part", _NAMES).select("id", metric.alias("metric"), unit.alias("unit"), region.alias("region"))


def _q_lineages(s, d):
    rows = made(s, d, "part", _KINDS)
    return rows.select("id", scoring_domain(F.col("lineage"), F.col("kind")).alias("domain"), lineage_of(F.col("other"), F.col("subclass"), F.col("class")).alias("lineage"))


def _q_plan(s, d):
    listed = made(s, d, "orders", {"key": "'in/' || CAST(o_orderkey % 2000 AS STRING) || '.csv'", "size": "o_orderkey % 500"}).where("size > 5")
    wanted = made(s, d, "part", {"key": "CASE p_partkey % 5 WHEN 0 THEN 'in/../' || CAST(p_partkey AS STRING) || '.csv' WHEN 1 THEN 'out/1.csv' WHEN 2 THEN 'in/1.txt' ELSE 'in/' || CAST(p_partkey AS STRING) || '.csv' END", "size": "p_partkey % 500"})
    return download_plan(wanted, listed, "in/", ".csv", most=1_000_000_000, largest=300)


QUERIES = {
    "path_tokens": _q_paths,
    "object_manifest": lambda s, d: object_manifest(made(s, d, "orders", _OBJECTS), "key", "size"),
    "section_file_roles": lambda s, d: made(s, d, "orders", _OBJECTS).select("key", first_match(F.regexp_extract("key", "([^/]*)$", 1), SECTION_ROLES, "other", lower=True).alias("section_role"), first_match(F.regexp_extract("key", "([^/]*)$", 1), SPATIAL_ROLES, "other", lower=True).alias("spatial_role"), gigabytes(F.col("size")).alias("gb")),
    "metric_family": _q_metrics,
    "marker_columns": lambda s, d: marker_columns(made(s, d, "part", _NAMES), "name"),
    "resolution_label": lambda s, d: resolution_label(made(s, d, "part", _LEVELS), "g", "level"),
    "domain_and_lineage": _q_lineages,
    "canonical_layer": lambda s, d: made(s, d, "part", _LAYER).select("id", canonical_layer(F.col("name")).alias("layer")),
    "subclass_from_file": lambda s, d: subclass_of(made(s, d, "part", _FILES), "token", made(s, d, "part", {"n": "p_type"}).union(made(s, d, "part", {"n": "p_brand"})), "n").select("id", "subclass"),
    "identifier_columns": lambda s, d: identifier_columns(made(s, d, "customer", _PEOPLE), list(_PEOPLE)),
    "download_plan": _q_plan,
}


def _case(text: str, rules: tuple, other: str | None, place: int = 1) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quote(r[0])}) THEN {quote(r[place])}" for r in rules) + f" ELSE {quote(other)} END"


_FILE = "regexp_extract(key, '([^/]*)$', 1)"
_CELLPOSE = lambda rules: tuple((".*cellpose.*transcript.*\\.csv$|.*transcript.*cellpose.*\\.csv$" if "(?=" in r[0] else r[0], r[1]) for r in rules)
_METRICS = tuple((f"(?i){p}", m, u) for p, m, u in METRICS)
_MAPPED = lambda text, pairs: f"CASE {text} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"
SQL = {
    "path_tokens": f"""WITH t AS (SELECT id, list_filter(string_split(key, '/'), lambda x: x <> '') AS t FROM {made_sql("orders", _KEYS)}),
      d AS (SELECT *, list_filter(t, lambda x: regexp_full_match(x, 'H\\d{{2}}\\.\\d{{2}}\\.\\d{{3}}'))[1] AS donor FROM t), s AS (SELECT *, CASE WHEN donor IS NOT NULL THEN t[list_position(t, donor) + 1] END AS section FROM d),
      c AS (SELECT *, string_split(CASE WHEN starts_with(section, donor || '-') THEN section[len(donor) + 2:] ELSE section END, '-') AS c FROM s)
      SELECT id, CAST(len(t) AS INT) AS n_tokens, donor, section, CASE WHEN len(c) >= 2 THEN c[-1] END AS stain, CASE WHEN len(c) >= 2 THEN array_to_string(c[:-2], '-') END AS block FROM c""",
    "object_manifest": f"""SELECT key, nullif(regexp_extract(key, '^([^/]+)/', 1), '') AS folder, {_FILE} AS file, round(size / 1e6, 6) AS size_mb, {_case("key", ASSAYS, "multiregion/model output")} AS assay,
      nullif(regexp_extract({_FILE}, '[A-Z]+_([A-Za-z0-9]+)_(?:RNAseq|ATACseq)', 1), '') AS region, nullif(regexp_extract({_FILE}, '^H\\d{{2}}\\.\\d{{2}}\\.\\d{{3}}'), '') AS donor, nullif(regexp_extract({_FILE}, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS release_date,
      CASE WHEN contains({_FILE}, 'all-nuclei') THEN 'all-nuclei' WHEN contains({_FILE}, 'final-nuclei') THEN 'final-nuclei' END AS nuclei_set, coalesce({_case("key", FAMILIES, None)}, {_case(_FILE, FILE_FAMILIES, "other")}) AS family FROM {made_sql("orders", _OBJECTS)}""",
    "section_file_roles": f"""SELECT key, {_case(f"lower({_FILE})", _CELLPOSE(SECTION_ROLES), "other")} AS section_role, {_case(f"lower({_FILE})", _CELLPOSE(SPATIAL_ROLES), "other")} AS spatial_role, round_even(size / 1073741824, 3) AS gb FROM {made_sql("orders", _OBJECTS)}""",
    "metric_family": f"""WITH b AS (SELECT *, regexp_replace(name, '{REGION_SUFFIX}', '') AS base FROM {made_sql("part", _NAMES)}) SELECT id, {_case("base", _METRICS, UNKNOWN_METRIC)} AS metric, {_case("base", _METRICS, None, 2)} AS unit, nullif(regexp_extract(name, '{REGION_SUFFIX}', 1), '') AS region FROM b""",
    "marker_columns": f"""WITH n AS (SELECT DISTINCT name FROM {made_sql("part", _NAMES)}), m(marker, pattern) AS (VALUES {", ".join(f"('{m}', '(?i){p}')" for m, p in MARKERS.items())}), h AS (SELECT name, marker FROM n JOIN m ON regexp_matches(name, pattern))
      SELECT name, marker, CAST(count(*) OVER (PARTITION BY name) AS INT) AS n_markers, count(*) OVER (PARTITION BY name) > 1 AS is_colocalization FROM h""",
    "resolution_label": f"""WITH a AS (SELECT g, list_sort(list(DISTINCT level) FILTER (WHERE level IS NOT NULL)) AS levels, concat_ws(' + ', {", ".join(f"max(CASE WHEN regexp_matches(level, '{p}') THEN '{say}' END)" for p, say in GRAINS)}) AS said FROM {made_sql("part", _LEVELS)} GROUP BY g)
      SELECT g, CASE WHEN levels IS NULL THEN 'not stated in sheet' WHEN said = '' THEN 'other: ' || array_to_string(levels, ', ') ELSE said END AS resolution FROM a""",
    "domain_and_lineage": f"""SELECT id, CASE WHEN lineage <> 'Immune' THEN lineage WHEN kind LIKE 'Micro-PVM%' THEN 'Micro/PVM' ELSE kind END AS domain, CASE WHEN other LIKE 'Micro-PVM%' THEN 'microglia_PVM' WHEN other IN ('Lymphocyte', 'Monocyte') THEN 'other_immune' WHEN subclass = 'Astrocyte' THEN 'astrocyte'
      WHEN subclass = 'Oligodendrocyte' THEN 'oligodendrocyte' WHEN subclass = 'OPC' THEN 'OPC' WHEN class LIKE 'Neuronal%' THEN 'neuron' ELSE 'other_non_neural' END AS lineage FROM {made_sql("part", _KINDS)}""",
    "canonical_layer": f"""WITH r AS (SELECT id, upper(replace(regexp_replace(trim(name), '(?i)^\\s*layer\\s*', ''), ' ', '')) AS r FROM {made_sql("part", _LAYER)}), c AS (SELECT id, 'L' || coalesce({_MAPPED("r", ROMAN)}, r) AS c FROM r) SELECT id, CASE WHEN c IN ('{"', '".join(LAYERS)}') THEN c END AS layer FROM c""",
    "subclass_from_file": f"""WITH k AS (SELECT p_type AS n FROM part UNION SELECT p_brand FROM part) SELECT id, coalesce({_MAPPED("token", IRREGULAR)}, (SELECT n FROM k WHERE n = token), (SELECT n FROM k WHERE n = replace(token, '-', ' '))) AS subclass FROM {made_sql("part", _FILES)}""",
    "identifier_columns": f"""WITH p AS (SELECT * FROM {made_sql("customer", _PEOPLE)}), u AS (UNPIVOT p ON COLUMNS(*) INTO NAME "column" VALUE value), v AS (SELECT "column", trim(value) AS value FROM u WHERE lower(trim(value)) NOT IN ('nan', 'none', 'null', ''))
      SELECT "column", regexp_matches("column", '(?i){"|".join(ID_WORDS)}') AS by_name, count(DISTINCT value) / count(*) >= 0.05 AND (avg(regexp_full_match(value, '\\d{{6,}}')::INT) > 0.01 OR avg(regexp_matches(value, 'H\\d{{2}}\\.\\d{{2}}\\.\\d{{3}}')::INT) > 0.01) AS by_values FROM v GROUP BY 1""",
    "download_plan": """WITH l AS (SELECT 'in/' || CAST(o_orderkey % 2000 AS VARCHAR) || '.csv' AS key, o_orderkey % 500 AS size FROM orders WHERE o_orderkey % 500 > 5), s AS (SELECT key, count(*) AS copies, max(size) AS there FROM l GROUP BY 1),
      w AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'in/../' || p_partkey || '.csv' WHEN 1 THEN 'out/1.csv' WHEN 2 THEN 'in/1.txt' ELSE 'in/' || p_partkey || '.csv' END AS key, p_partkey % 500 AS size FROM part)
      SELECT w.key, size, CASE WHEN count(*) OVER (PARTITION BY w.key) > 1 THEN 'key repeated' WHEN w.key NOT LIKE 'in/%' THEN 'wrong prefix' WHEN w.key NOT LIKE '%.csv' THEN 'wrong suffix' WHEN w.key LIKE '%/../%' THEN 'path leaves the folder'
        WHEN coalesce(copies, 0) <> 1 THEN 'not exactly one listed object' WHEN size <> there THEN 'size differs' WHEN size > 300 THEN 'too large' ELSE 'fetch' END AS decision FROM w LEFT JOIN s ON w.key = s.key""",
}
