"""Column functions: filters, labels, vectors and small formulas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Prefixes of control probes.
CONTROL_PREFIXES = ["UnassignedCodeword", "BLANK", "DeprecatedCodeword", "NegControlCodeword", "NegControlProbe", "antisense_"]

# Categories of locations and the words that tell them, the first that fits counts.
LOCATION_WORDS = [
    ("Secreted/Extracellular", ["secreted", "extracellular"]),
    ("Membrane", ["membrane", "cell surface"]),
    ("Nucleus", ["nucleus"]),
    ("Cytoplasm", ["cytoplasm", "cytosol"]),
    ("Mitochondria", ["mitochondri"]),
    ("ER/Golgi", ["endoplasmic reticulum", "golgi"]),
]
# Categories of terms and the words that tell them, the first that fits counts.
TERM_WORDS = [
    ("Enzymatic", ["kinase", "phosphatase", "enzyme", "catalytic"]),
    ("Receptor", ["receptor", "ligand binding"]),
    ("Transcription factor", ["transcription factor", "dna binding", "transcription"]),
    ("Transporter", ["transport", "channel", "carrier"]),
    ("Structural", ["structural", "cytoskeleton", "extracellular matrix"]),
    ("Signaling", ["signal", "signaling"]),
]
# Categories by the beginning of a gene's name.
NAME_PREFIXES = [
    ("Structural", ["COL", "KRT", "ACT"]),
    ("Receptor/Immune", ["CD", "HLA"]),
    ("Signaling/Cytokine", ["IL", "CXCL", "CCL"]),
    ("Enzymatic", ["MMP", "ADAM"]),
    ("Transporter", ["SLC", "ABC"]),
]
# Small location categories that are merged.
MERGED_LOCATIONS = {"ER/Golgi": "Cytoplasm", "Mitochondria": "Cytoplasm", "Other": "Unknown"}
# Numeric classes of nuclei.
NUCLEUS_CLASSES = {0: "background", 1: "neoplastic", 2: "inflammatory", 3: "connective", 4: "necrotic", 5: "non_neoplastic_epithelial"}
# Cell types and their genes.
CELL_TYPE_GENES = {
    "epithelial": ["EPCAM", "KRT18", "KRT19", "KRT8", "CDH1", "MUC1"],
    "fibroblast": ["COL1A1", "COL3A1", "DCN", "FAP", "ACTA2", "VIM", "LUM"],
    "T_cell": ["CD3D", "CD3E", "CD8A", "CD4", "GZMB", "PRF1"],
    "macrophage": ["CD68", "CD163", "CSF1R", "CD14", "ITGAM"],
    "B_cell": ["CD79A", "CD79B", "MS4A1", "CD19"],
    "endothelial": ["PECAM1", "VWF", "CDH5", "ERG"],
    "NK_cell": ["NCAM1", "NKG7", "GNLY", "KLRD1"],
    "mast_cell": ["KIT", "TPSAB1", "TPSB2", "CPA3"],
}


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def cases(rules: Sequence[tuple[str, Column]], other: Column) -> Column:
    """The label of the first rule that holds."""
    return reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(rules), other)


def is_control_probe(name: Column, prefixes: Sequence[str] = CONTROL_PREFIXES) -> Column:
    return any_of([name.startswith(p) for p in prefixes])


def spot_key(sample: Column, barcode: Column) -> Column:
    return F.concat_ws("_", sample, barcode)


def barcode_of(key: Column, sample: Column) -> Column:
    """The key without its sample; null if the key is of another sample."""
    return F.when(F.startswith(key, F.concat(sample, F.lit("_"))), F.substring(key, F.length(sample) + 2, F.length(key)))


def has_nan(vector: Column) -> Column:
    """Whether a vector is null or holds a null or NaN."""
    return vector.isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def mean_abs(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.abs(x), lambda s: s / F.size(vector))


def row_summary(columns: Sequence[Column]) -> dict[str, Column]:
    """min, max, mean and range over columns without nulls."""
    low, high = F.least(*columns), F.greatest(*columns)
    return {"row_min": low, "row_max": high, "row_mean": reduce(lambda a, b: a + b, columns) / len(columns), "row_range": high - low}


def standardised(df: DataFrame, value: str, keys: Sequence[str], zero_as_one: bool = False) -> DataFrame:
    """Population z-scores of ``value`` within ``keys`` as ``z``; a constant column gives 0 (or its difference from the mean, if a zero deviation counts as 1)."""
    w = W.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    gap = F.col(value) - F.avg(value).over(w)
    return df.withColumn("z", gap / F.when(sd == 0, 1.0).otherwise(sd) if zero_as_one else F.coalesce(F.when(sd > 0, gap / sd), F.lit(0.0)))


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """An indicator for each category but the first in sort order."""
    return df.withColumns({f"{column}_{c}": (F.coalesce(F.col(column) == c, F.lit(False))).cast("double") for c in sorted(categories)[1:]})


def number(x: Column) -> Column:
    """As a number; 0 for what is none."""
    return F.coalesce(F.nanvl(x.try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The unit vector; zeros stay zeros."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def location_class(locations: Column) -> Column:
    """Category of an array of locations."""
    said = F.lower(F.array_join(locations, " "))
    rules = [(label, any_of([F.contains(said, F.lit(w)) for w in words])) for label, words in LOCATION_WORDS]
    return cases(rules, F.when(F.size(locations) > 0, "Other").otherwise("Unknown"))


def term_class(terms: Column) -> Column:
    said = F.lower(F.array_join(terms, " "))
    return cases([(label, any_of([F.contains(said, F.lit(w)) for w in words])) for label, words in TERM_WORDS], F.lit("Other"))


def name_class(gene: Column, prefixes: Sequence[tuple[str, Sequence[str]]] = NAME_PREFIXES) -> Column:
    g = F.upper(gene)
    return cases([(label, any_of([g.startswith(p) for p in ps])) for label, ps in prefixes], F.lit("Other"))


def mapped(x: Column, table: Mapping) -> Column:
    """The table's value, or what was there as text."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x), x.cast("string"))


def data_source(sample: Column) -> Column:
    return F.when(sample.startswith("NCBI"), "Janesick").when(sample.startswith("TENX9"), "10x Public").otherwise("Biomarkers")


def pathway_name(name: Column, names: Mapping[str, str] | None = None, prefix: str = "HALLMARK_") -> Column:
    key = F.replace(name, F.lit(prefix), F.lit(""))
    plain = F.initcap(F.translate(key, "_", " "))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), key), plain) if names else plain


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def volcano(fdr: Column) -> Column:
    return -F.log10(F.greatest(fdr, F.lit(1e-300)))


def reproducibility_height(r: Column) -> Column:
    return -F.log10(1 - F.least(r, F.lit(0.9999)) + 1e-10)


def same_sign(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)


def min_max(x: Column, keys: Sequence[str]) -> Column:
    w = W.partitionBy(*keys)
    low, span = F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)
    return (x - low) / F.when(span == 0, 1.0).otherwise(span)


def grid_cell(x: Column, n: int) -> Column:
    """The cell of a place from 0 to 1: as many inner edges i/n as are not above it; 0 for a null.

    Edges are compared one by one: within a lambda Spark takes a column's name for an alias of the same
    ``select`` where there is one, so a place beside its own rounded self would be binned as rounded.
    """
    return sum((F.coalesce(x >= F.lit(i / n), F.lit(False)).cast("int") for i in range(1, n)), F.lit(0))


def polygon_area(ring: Column) -> Column:
    """Area of an array of points [x, y] by the shoelace sum over neighbouring points; the last point is not joined to the first."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.when(n > 1, F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(0.0)


def ring_centroid(ring: Column) -> Column:
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


def interval95(beta: Column, se: Column) -> dict[str, Column]:
    return {"low": beta - 1.96 * se, "high": beta + 1.96 * se}


def in_tissue(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(True))


def replicates(repro_a: Column, repro_b: Column, effect_a: Column, effect_b: Column, least: float = 0.5) -> Column:
    return (repro_a > least) & (repro_b > least) & same_sign(effect_a, effect_b)
