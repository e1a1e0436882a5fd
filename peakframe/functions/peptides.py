"""Column functions on peptide annotations.

An annotation is a string of residues, in which ``(RESIDUES,mass)`` is a group with a mass shift and ``[mass]`` a gap
of that mass; ``X.`` before and ``.X`` after name the neighbours. All functions are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monoisotopic residue masses.
RESIDUE_MASS = {
    "A": 71.037113787, "R": 156.101111026, "D": 115.026943031, "N": 114.042927446, "C": 103.009184477, "E": 129.042593095, "Q": 128.058577510,
    "G": 57.021463723, "H": 137.058911861, "I": 113.084063979, "L": 113.084063979, "K": 128.094963016, "M": 131.040484605, "F": 147.068413915,
    "P": 97.052763851, "S": 87.032028409, "T": 101.047678473, "W": 186.079312952, "Y": 163.063328537, "V": 99.068413915,
}
HYDROGEN, WATER = 1.007825035, 18.010564686
GROUP = r"\(([A-Z]+),[^)]*\)"
TOKEN = r"\([A-Z]+,-?[0-9.]+\)|\[-?[0-9.]+\]|[A-Z]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ends(a: Column | str) -> Column:
    """Without the neighbours: ``K.ACD.R`` gives ``ACD``."""
    return F.regexp_replace(F.regexp_replace(_c(a), r"^[A-Z_*-]\.", ""), r"\.[A-Z_*-]$", "")


def add_ends(a: Column | str, before: str = "*", after: str = "*") -> Column:
    return F.concat(F.lit(before + "."), strip_ends(a), F.lit("." + after))


def strip_mods(a: Column | str) -> Column:
    """``(S,79.9)`` becomes ``S``; gaps stay."""
    return F.regexp_replace(_c(a), GROUP, "$1")


def unmodified(a: Column | str) -> Column:
    """Residues alone: no neighbours, groups or gaps."""
    return F.regexp_replace(strip_mods(strip_ends(a)), r"[^A-Z]", "")


def tokens(a: Column | str) -> Column:
    """The residues, groups and gaps, one by one."""
    return F.regexp_extract_all(strip_ends(a), F.lit(TOKEN), 0)


def shifts(a: Column | str) -> Column:
    """The numbers of all groups and gaps."""
    return F.transform(F.regexp_extract_all(_c(a), F.lit(r"[,\[](-?[0-9.]+)[\])]"), 1), lambda m: m.cast("double"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def residue_masses(a: Column | str) -> Column:
    """Mass of each residue letter (null for one without a mass)."""
    table = F.create_map(*[F.lit(v) for kv in RESIDUE_MASS.items() for v in kv])
    return F.transform(F.filter(F.split(unmodified(a), ""), lambda r: r != ""), lambda r: F.try_element_at(table, r))


def mod_mass(a: Column | str) -> Column:
    return _total(shifts(a))


def peptide_mass(a: Column | str) -> Column:
    return _total(residue_masses(a)) + mod_mass(a)


def peptide_length(a: Column | str) -> Column:
    """Residues, each gap counting as one."""
    return F.length(unmodified(a)) + F.regexp_count(_c(a), F.lit(r"\["))


def jump_count(a: Column | str) -> Column:
    return F.size(tokens(a))


def gap_count(a: Column | str) -> Column:
    return F.regexp_count(_c(a), F.lit(r"\["))


def reverse_peptide(a: Column | str) -> Column:
    """Reversed token by token, so that groups and gaps stay whole."""
    return F.array_join(F.reverse(tokens(a)), "")


def is_valid(a: Column | str) -> Column:
    return strip_ends(a).rlike(rf"^(?:{TOKEN})+$")


def format_mod(residues: Column | str, mass: Column | str) -> Column:
    return F.format_string("(%s,%.2f)", _c(residues), _c(mass).cast("double"))


def mods_and_positions(a: Column | str) -> Column:
    """(mass, position, length) of each group and gap: residues up to its end, and residues in it (a gap has none)."""
    t = tokens(a)
    count = lambda x: F.when(x.startswith("["), 0).otherwise(F.length(F.regexp_replace(x, r"[^A-Z]", "")))
    marked = F.transform(t, lambda x, i: F.struct(F.aggregate(F.transform(F.slice(t, F.lit(1), i + 1), count), F.lit(0), lambda s, v: s + v).alias("position"), x.alias("token")))
    mods = F.filter(marked, lambda x: ~x.token.rlike("^[A-Z]$"))
    return F.transform(mods, lambda x: F.struct(F.regexp_extract(x.token, r"(-?[0-9.]+)[\])]$", 1).cast("double").alias("mass"), x.position.alias("position"), count(x.token).alias("length")))


def from_signed(a: Column | str) -> Column:
    """``AC+57.02D`` becomes ``A(C,57.02)D``; a shift before the first residue becomes a gap."""
    x = F.regexp_replace(_c(a), r"([A-Z])\+?(-?[0-9]+(?:\.[0-9]+)?)", "($1,$2)")
    return F.regexp_replace(x, r"^\+?(-?[0-9]+(?:\.[0-9]+)?)", "[$1]")


def insert_mods(peptide: Column | str, mods: Column | str) -> Column:
    """The inverse of ``mods_and_positions`` for groups of one residue: mods is an array of (mass, position)."""
    m = _c(mods)
    letters = F.filter(F.split(_c(peptide), ""), lambda r: r != "")
    of = lambda i: F.filter(m, lambda x: x.position == i + 1)
    put = F.transform(letters, lambda r, i: F.when(F.size(of(i)) > 0, format_mod(r, F.try_element_at(of(i), F.lit(1)).mass)).otherwise(r))
    return F.array_join(put, "")


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places that differ; -1 for different lengths."""
    a, b = _c(a), _c(b)
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(F.length(a) != F.length(b), -1).otherwise(differ)


def prefixes(a: Column | str) -> Column:
    a = _c(a)
    return F.when(F.length(a) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda n: F.substring(a, F.lit(1), n)))


def suffixes(a: Column | str) -> Column:
    a = _c(a)
    return F.when(F.length(a) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda n: F.substring(a, F.length(a) - n + 1, n)))


def kmers(a: Column | str, k: int) -> Column:
    """All k-mers, in order, with their start from 0."""
    a = _c(a)
    at = F.sequence(F.lit(0), F.greatest(F.length(a) - k, F.lit(0)))
    return F.filter(F.transform(at, lambda i: F.struct(i.alias("start"), F.substring(a, i + 1, F.lit(k)).alias("kmer"))), lambda x: F.length(x.kmer) == k)


def _running(m: Column) -> Column:
    return F.aggregate(m, F.array().cast("array<double>"), lambda sums, x: F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0.0)) + x)))


def prefix_masses(a: Column | str) -> Column:
    """Running mass after each residue."""
    return _running(residue_masses(a))


def suffix_masses(a: Column | str) -> Column:
    return _running(F.reverse(residue_masses(a)))


def theoretical_ions(a: Column | str) -> Column:
    """(ion, position, mz) of the singly charged b and y ions."""
    but_last = lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))

    def ions(m):
        b = F.transform(_running(but_last(m)), lambda m, i: F.struct(F.lit("b").alias("ion"), (i + 1).alias("position"), (m + HYDROGEN).alias("mz")))
        y = F.transform(_running(but_last(F.reverse(m))), lambda m, i: F.struct(F.lit("y").alias("ion"), (i + 1).alias("position"), (m + WATER + HYDROGEN).alias("mz")))
        return F.concat(b, y)

    return F.transform(F.array(residue_masses(a)), ions)[0]  # the masses are bound once


def decoy_peptide(a: Column | str, charge: Column | str) -> Column:
    """A shuffle by digests of peptide, charge and place; R, K and P keep their places."""
    a, z = _c(a), _c(charge)
    letters = F.filter(F.split(a, ""), lambda r: r != "")
    marked = F.transform(letters, lambda r, i: F.struct(F.md5(F.concat_ws(":", a, z.cast("string"), i.cast("string")).cast("binary")).alias("key"), i.alias("at"), r.alias("r")))
    loose = F.filter(marked, lambda x: ~x.r.isin("R", "K", "P"))
    # bound once: a lambda would compute them anew for each residue
    bound = F.array(F.struct(letters.alias("letters"), F.transform(loose, lambda x: x.at).alias("places"), F.array_sort(loose).alias("mixed")))
    put = lambda s: F.transform(s.letters, lambda r, i: F.when(r.isin("R", "K", "P"), r).otherwise(F.try_element_at(s.mixed, F.array_position(s.places, i).cast("int")).r))
    return F.array_join(F.transform(bound, put)[0], "")


def fold_residues(a: Column | str) -> Column:
    """Residues that masses can't tell: L as I, K as Q."""
    return F.translate(_c(a), "LK", "IQ")


def path_parts(p: Column | str) -> Column:
    """(folder, name, extension) of a path."""
    p = _c(p)
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return F.struct(F.regexp_extract(p, r"^(.*)/", 1).alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("name"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"))


def ion_sets(text: Column | str) -> Column:
    """``CID=b,y;ETD=c,z`` as a map of arrays."""
    return F.transform_values(F.str_to_map(_c(text), F.lit(";"), F.lit("=")), lambda k, v: F.split(v, ","))
