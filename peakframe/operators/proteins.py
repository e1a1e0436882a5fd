"""Operators on protein sequences: k-mer index, tag and peptide search, decoys, coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import peptides as P
from ..session import importable
from .band_join import SLACK
from .shuffled import shuffled


def reversed_decoys(proteins: DataFrame, prefix: str = "XXX") -> DataFrame:
    return proteins.unionByName(proteins.withColumns({"id": F.concat(F.lit(prefix), F.col("id")), "seq": F.reverse("seq")}))


def shuffled_decoys(proteins: DataFrame, prefix: str = "XXX") -> DataFrame:
    """Each sequence's letters in an order given by a digest of the sequence and the place."""
    importable(proteins.sparkSession)
    name, seq = proteins.columns.index("id"), proteins.columns.index("seq")

    def run(batches):
        for b in batches:
            yield b
            mixed = pa.array(shuffled(b.column(seq).to_pylist()), b.schema.field(seq).type)
            called = pa.array([None if x is None else f"{prefix}{x}" for x in b.column(name).to_pylist()], b.schema.field(name).type)
            yield b.set_column(seq, b.schema.field(seq), mixed).set_column(name, b.schema.field(name), called)

    return proteins.mapInArrow(run, proteins.schema)


def kmer_index(proteins: DataFrame, k: int, stretch: int = 400) -> DataFrame:
    """kmer, prot_idx, start: a row for each place. Sequences are first cut into overlapping stretches, so the cost is linear in their length."""
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - k, F.lit(0)), F.lit(stretch)))
    parts = proteins.select("prot_idx", "seq", cut.alias("__from")).select("prot_idx", "__from", F.substring("seq", F.col("__from") + 1, F.lit(stretch + k - 1)).alias("part"))
    return parts.select("prot_idx", "__from", F.explode(P.kmers("part", k)).alias("x")).select("x.kmer", "prot_idx", (F.col("__from") + F.col("x.start")).alias("start"))


def find_tags(proteins: DataFrame, tags: DataFrame, k: int, tol: float, least_flanks: int = 1) -> DataFrame:
    """Places of tags (tag_id, tag, prefix_mass, suffix_mass) whose flanking residues add up to the flanking masses.

    The tags meet k-mers by equality; residues are then walked outwards by prefix sums within the row.
    """
    masses = proteins.select("prot_idx", F.col("seq"))
    hit = kmer_index(proteins, k).join(tags, F.col("kmer") == F.col("tag")).join(masses, "prot_idx")
    reach = lambda mass: F.ceil((F.abs(F.coalesce(F.col(mass), F.lit(0.0))) + tol + 1e-4) / min(P.RESIDUE_MASS.values())).cast("int")  # noqa: E731  # no more residues weigh so much
    left = P.suffix_masses(F.substring("seq", F.greatest(F.col("start") - reach("prefix_mass"), F.lit(0)) + 1, F.least(F.col("start"), reach("prefix_mass"))))
    right = P.prefix_masses(F.substring("seq", F.col("start") + k + 1, reach("suffix_mass")))

    def matched(sums, mass):
        near = F.filter(F.transform(sums, lambda m, i: F.when(F.abs(m - F.col(mass)) <= tol + 1e-4, i + 1)), lambda i: i.isNotNull())
        return F.when(F.abs(F.col(mass)) <= tol + 1e-4, F.lit(0)).otherwise(F.try_element_at(near, F.lit(1)))

    found = hit.withColumn("before", matched(left, "prefix_mass")).withColumn("after", matched(right, "suffix_mass"))
    flanks = F.col("before").isNotNull().cast("int") + F.col("after").isNotNull().cast("int")
    peptide = F.substring("seq", F.col("start") - F.coalesce("before", F.lit(0)) + 1, F.coalesce("before", F.lit(0)) + k + F.coalesce("after", F.lit(0)))
    return found.withColumn("flanks", flanks).where(F.col("flanks") >= least_flanks).select("tag_id", "prot_idx", "start", "flanks", peptide.alias("peptide"))


def proteins_with(proteins: DataFrame, peptides: DataFrame, k: int = 5) -> DataFrame:
    """peptide, prot_idx for each protein that holds the peptide: the first k residues meet by equality, the rest is checked."""
    return occurrences(proteins, peptides, k).select("peptide", "prot_idx").distinct()


#: Peptides up to this number are sent to all tasks, where each text is read once and nothing is shuffled; more of them meet the index in a join.
SENT = 300_000


def occurrences(proteins: DataFrame, peptides: DataFrame, k: int = 5, sent: int = SENT) -> DataFrame:
    """peptide, prot_idx, start: each place, overlapping ones too. The first residues (k at most) find the places, and the whole peptide is checked there."""
    wanted = peptides.where("peptide <> ''").select("peptide").distinct()
    some = [r[0] for r in wanted.limit(sent + 1).collect()]
    if len(some) <= sent:
        return _places(proteins, some, min(k, 5))
    long = wanted.where(F.length("peptide") >= k).withColumn("kmer", F.substring("peptide", 1, k))
    hit = kmer_index(proteins, k).join(long, "kmer").join(proteins.select("prot_idx", "seq"), "prot_idx")
    out = hit.where(F.substring("seq", F.col("start") + 1, F.length("peptide")) == F.col("peptide")).select("peptide", "prot_idx", "start")
    short = wanted.where(F.length("peptide") < k)
    for width in range(1, k):
        part = short.where(F.length("peptide") == width).select("peptide", F.col("peptide").alias("kmer"))
        out = out.unionByName(kmer_index(proteins, width).join(part, "kmer").select("peptide", "prot_idx", "start"))
    return out


def _places(proteins: DataFrame, peptides: list[str], k: int) -> DataFrame:
    """Places of given peptides: five bits of each of the first residues make a number, by which places are looked up in a table before the text is compared."""
    importable(proteins.sparkSession)
    sent = proteins.sparkSession.sparkContext.broadcast(peptides)
    schema = StructType([StructField("peptide", StringType()), StructField("prot_idx", proteins.schema["prot_idx"].dataType), StructField("start", IntegerType())])
    out_schema = to_arrow_schema(schema)

    def run(batches):
        code = lambda x, w: sum((x[j : len(x) - w + 1 + j] << np.uint32(5 * (w - 1 - j)) for j in range(w)), np.zeros(len(x) - w + 1, np.uint32))
        letters = lambda text: np.frombuffer(text.encode("utf-32-le"), np.uint32) & np.uint32(31)
        tables: dict[int, tuple[np.ndarray, dict[int, list[str]]]] = {}
        for p in sent.value:
            w = min(k, len(p))
            there, of = tables.setdefault(w, (np.zeros(1 << 5 * w, bool), {}))
            c = int(code(letters(p[:w]), w)[0])
            there[c] = True
            of.setdefault(c, []).append(p)
        for b in batches:
            found: list[tuple] = []
            for at, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = letters(text or "")
                for w, (there, of) in tables.items():
                    if len(x) >= w:
                        c = code(x, w)
                        near = np.flatnonzero(there[c])
                        found += [(p, at, i) for i, n in zip(near.tolist(), c[near].tolist(), strict=True) for p in of[n] if text.startswith(p, i)]
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(list(zip(*found, strict=True)) or [(), (), ()], out_schema.types, strict=True)], schema=out_schema)

    return proteins.select("prot_idx", "seq").mapInArrow(run, schema)


def coverage(proteins: DataFrame, hits: DataFrame) -> DataFrame:
    """prot_idx, covered, length, percent, redundancy (hits for each covered residue) of hits (prot_idx, first, last), first from 0."""
    at = hits.select("prot_idx", F.explode(F.sequence("first", "last")).alias("residue")).groupBy("prot_idx", "residue").agg(F.count("*").alias("n"))
    per = at.groupBy("prot_idx").agg(F.count("*").alias("covered"), F.avg("n").alias("redundancy"))
    p = proteins.select("prot_idx", F.length("seq").alias("length"))
    return p.join(per, "prot_idx", "left").select("prot_idx", F.coalesce("covered", F.lit(0)).alias("covered"), "length", F.coalesce(F.try_divide(F.col("covered") * 100, F.col("length")), F.lit(0.0)).alias("percent"), "redundancy")


def equivalent_tags(tags: DataFrame) -> DataFrame:
    """All spellings of each tag with I for L and Q for K, and the reverse."""
    options = F.transform(F.filter(F.split("tag", ""), lambda r: r != ""), lambda r: F.when(r.isin("I", "L"), F.array(F.lit("I"), F.lit("L"))).when(r.isin("Q", "K"), F.array(F.lit("Q"), F.lit("K"))).otherwise(F.array(r)))
    spelt = F.aggregate(options, F.array(F.lit("")), lambda a, o: F.flatten(F.transform(a, lambda s: F.transform(o, lambda x: F.concat(s, x)))))
    return tags.withColumn("spelling", F.explode(spelt))


def mass_to_peptides(proteins: DataFrame, masses: DataFrame, tol: float, longest: int = 12) -> DataFrame:
    """Stretches of up to ``longest`` residues whose mass is near each (mass_id, mass): prot_idx, start, stop, gap, mass_id, mass.

    ``masses`` is a literal table. Each text's running masses are compared in one task; texts are never exploded or shuffled.
    """
    importable(proteins.sparkSession)
    wanted = [tuple(r) for r in masses.select("mass_id", "mass").collect() if r["mass"] is not None]
    weight = np.zeros(256)
    for letter, m in P.RESIDUE_MASS.items():
        weight[ord(letter)] = m
    texts = proteins.select("prot_idx", P.unmodified("seq").alias("seq"))
    kinds = {f.name: f.dataType for f in [*proteins.schema, *masses.schema]}
    schema = StructType([StructField("prot_idx", kinds["prot_idx"]), StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("gap", DoubleType()), StructField("mass_id", kinds["mass_id"]), StructField("mass", kinds["mass"])])
    out_schema = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for k, text in zip(b.column(0), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                total = np.concatenate([[0.0], np.cumsum(weight[np.frombuffer(text.as_py().encode(), np.uint8)])])
                for n in range(1, min(longest, len(total) - 1) + 1):
                    gap = total[n:] - total[:-n]
                    for mass_id, mass in wanted:
                        at = np.flatnonzero(np.abs(gap - float(mass)) <= tol + SLACK)
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(at), out_schema.types[0]), pa.array(at, pa.int32()), pa.array(at + n - 1, pa.int32()), pa.array(gap[at]), pa.array([mass_id] * len(at), out_schema.types[4]), pa.array([mass] * len(at), out_schema.types[5])], schema=out_schema)

    return texts.mapInArrow(run, schema)


def total_coverage(covered: DataFrame) -> DataFrame:
    """percent of all proteins' residues that are covered, from ``coverage``."""
    return covered.agg(F.coalesce(F.try_divide(F.sum("covered") * 100, F.sum("length")), F.lit(0.0)).alias("percent"))
