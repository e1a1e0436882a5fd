import struct

import pytest
from pyspark.sql import functions as F

from peakframe.functions import peptides as P
from peakframe.plans import modules
from peakframe.sources import spectra_text as S
from peakframe.sources import tables as T
from peakframe.streaming import ingest


def _spectra(spark):
    rows = [("f.mgf", i, f"t{i}", 400.0 + i, (400.0 + i) * 2 - S.HYDROGEN, 2, 2, "CID", "PEPTIDE" if i else None, [(100.0 + k, 1.0 + k) for k in range(3)]) for i in range(3)]
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in S.SCHEMA))


@pytest.mark.parametrize("kind", ["mgf", "pkl", "ms2", "dta", "parquet"])
def test_round_trip(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    S.save(_spectra(spark), path, kind)
    back = S.load(spark, path + ("/*/*.txt" if kind == "dta" else "/*.txt" if kind != "parquet" else ""), kind)
    key = lambda r: (round(r.parent_mass, 3), r.parent_charge, [(p.mz, p.intensity) for p in r.peaks])
    got, want = sorted(map(key, back.collect())), sorted(map(key, _spectra(spark).collect()))
    assert [g[1:] for g in got] == [w[1:] for w in want]
    if kind not in ("pkl",):
        assert [g[0] for g in got] == [w[0] for w in want]


def test_mgf_fields(spark, tmp_path):
    p = tmp_path / "a.mgf"
    p.write_bytes(b"BEGIN IONS\r\nTITLE=Scan Number: 17\r\nPEPMASS=500.5 99\r\nCHARGE=3+\r\nSEQ=AC\r\n100.1\t5\r\n200.2 6\r\nEND IONS\r\n\r\nBEGIN IONS\nPEPMASS=1\nEND IONS\n")
    a, b = sorted(S.load(spark, str(p)).collect(), key=lambda r: -r.parent_mz)
    assert (a.scan, a.parent_charge, a.annotation, [tuple(x) for x in a.peaks]) == (17, 3, "AC", [(100.1, 5.0), (200.2, 6.0)])
    assert b.peaks == [] and b.scan is None
    with pytest.raises(ValueError):
        S.load(spark, "x.unknown")


def test_tables(spark, tmp_path):
    (tmp_path / "f.fa").write_text(">p1 first\nACD\n;note\nEFX\n>p2\nGGG\n")
    assert [(r.id, r.desc, r.seq) for r in T.read_fasta(spark, str(tmp_path / "f.fa")).collect()] == [("p1", "first", "ACDEF"), ("p2", "", "GGG")]
    (tmp_path / "m.tsv").write_text("#SpecFile\tSpecID\tScanNum\tCharge\tProtein\tPeptide\tSpecEValue\tQValue\nf\tid scan=12\t-1\t2\tP\tAC\t1e-9\t0.01\n")
    r = T.read_psms(spark, str(tmp_path / "m.tsv"), "msgfplus").first()
    assert (r.scan, r.charge, r.annotation, r.p_value) == (12, 2, "AC", 0.01)
    with pytest.raises(T.MissingHeader):
        T.read_psms(spark, str(tmp_path / "m.tsv"), "moda")
    T.write_psms(spark.createDataFrame([(1, "f", "AC", 2, "P", 3.5, True)], "scan int, spectrum_file string, annotation string, charge int, protein string, score double, is_decoy boolean"), str(tmp_path / "out"))
    back = T.read_psms(spark, str(tmp_path / "out"), "native").first()
    assert (back.scan, back.score, back.is_decoy) == (1, 3.5, True)
    (tmp_path / "p.bin").write_bytes(struct.pack("<I", 1) + struct.pack("<6f", 1, 3, 0.5, -2, 7, 8))
    p = T.read_pairs_binary(spark, str(tmp_path / "p.bin")).first()
    assert (p.spec1, p.spec2, p.score1, p.shift1, p.spec2rev) == (0, 2, 7.0, 0.5, False)
    (tmp_path / "aa.txt").write_text("2\nA=71.03\nG=57.02\n")
    assert {r.residue: r.mass for r in T.read_masses(spark, str(tmp_path / "aa.txt")).collect()} == {"A": 71.03, "G": 57.02}
    (tmp_path / "m.mat").write_text("# x\n  A R\nA 4 -1\nR -1 5\n")
    assert {(r.a, r.b): r.score for r in T.read_substitution_matrix(spark, str(tmp_path / "m.mat")).collect()} == {("A", "A"): 4, ("A", "R"): -1, ("R", "A"): -1, ("R", "R"): 5}
    assert T.read_parameters("A=1\r\nB=$A/x\nnothing") == {"A": "1", "B": "1/x"}
    assert T.read_parameters_xml('<p><parameter name="K">v</parameter></p>') == {"K": "v"}
    assert T.read_svm_model("gamma 0.5\nrho 1\nSV\n0.3 1:2 3:4\n") == {"gamma": 0.5, "rho": 1.0, "alphas": [0.3], "vectors": [[2.0, 0.0, 4.0]]}


def test_peptide_functions(spark):
    df = spark.createDataFrame([("K.A(ST,79.97)C[57.02]D.R", 2), ("PEPTIDE", 3)], "a string, z int")
    a, b = df.select(P.unmodified("a").alias("u"), P.peptide_length("a").alias("n"), P.reverse_peptide("a").alias("r"), P.mods_and_positions("a").alias("m"), P.is_valid("a").alias("v"), P.decoy_peptide("a", "z").alias("d"), P.from_signed(F.lit("AC+57.02D")).alias("s"), P.insert_mods(F.lit("AC"), F.array(F.struct(F.lit(16.0).alias("mass"), F.lit(2).alias("position")))).alias("i")).collect()
    assert a.u == "ASTCD" and a.n == 6 and a.r == "D[57.02]C(ST,79.97)A" and a.v
    assert [(m.mass, m.position, m.length) for m in a.m] == [(79.97, 3, 2), (57.02, 4, 0)]
    assert a.s == "A(C,57.02)D" and a.i == "A(C,16.00)"
    assert sorted(b.d) == sorted("PEPTIDE") and [c for c in b.d if c in "RKP"] == ["P", "P"] and b.d[0] == b.d[2] == "P"


def test_modules(spark):
    scored = spark.createDataFrame([(1, 2, 0.9, 0.9, 0.0, 0.0), (1, 3, 0.1, 0.2, 0.0, 0.0), (2, 3, 0.5, 0.5, 0.0, 0.0)], "spec1 long, spec2 long, score1 double, score2 double, shift1 double, shift2 double")
    assert modules.execute("pairs_info", "TOP_K=1\nOTHER=2", {"scored": scored}).count() == 1
    for name, options, inputs in (("nothing", {}, {}), ("pairs_info", {}, {}), ("pairs_info", {"x": 1}, {"scored": scored}), ("fdr_peptide", {}, {"matches": scored}), ("pairs_info", {"top_k": "a"}, {"scored": scored})):
        with pytest.raises(modules.ModuleError):
            modules.run(name, options, inputs)


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, float(i)) for i in range(9)], "scan int, score double")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_parquet(spark, str(tmp_path / "in"), rows)
    q = ingest.in_batches(stream, lambda b: b.groupBy("scan").agg(F.max("score").alias("best")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("scan").agg(F.max("best")).count() == 3
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("score")))
    assert {r.scan: r.score for r in ingest.best_in_window(timed, "ts", ["scan"], "score").collect()} == {0: 6.0, 1: 7.0, 2: 8.0}


def test_mzxml(spark, tmp_path):
    import base64

    from peakframe.sources.mzxml import read_mzxml

    packed = base64.b64encode(struct.pack(">4f", 100.5, 7, 200.25, 9)).decode()
    (tmp_path / "a.mzXML").write_text(f'<msRun><scan num="3" msLevel="2" retentionTime="PT12.5S"><precursorMz precursorCharge="2" precursorIntensity="5.0">450.25</precursorMz><peaks precision="32">{packed}</peaks></scan><scan num="4" msLevel="1"><peaks precision="32"></peaks></scan></msRun>')
    a, b = sorted(read_mzxml(spark, str(tmp_path / "a.mzXML")).collect())
    assert (a.scan, a.ms_level, a.retention_time, a.parent_mz, a.parent_charge) == (3, 2, 12.5, 450.25, 2)
    assert [tuple(p) for p in a.peaks] == [(100.5, 7.0), (200.25, 9.0)] and b.peaks == []
