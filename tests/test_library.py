import gzip
import hashlib
from types import SimpleNamespace

import numpy as np
import pytest
from methylspark import staging
from methylspark.functions import arrays
from methylspark.functions.statistics import statistic
from methylspark.operators import dna, evaluation, intervals, model, motifs, neighbors, sites, weights, windows
from methylspark.operators.running import equi_depth, first_rows, running
from methylspark.plans import features
from methylspark.sources import readers, store, writers
from methylspark.sources.profiles import scan_profiles
from pyspark.sql import functions as F


def spans(spark, rows):
    return spark.createDataFrame([("1", a, b) for a, b in rows], "chromo string, start int, end int")


def random_spans(seed, n, high, longest):
    rnd = np.random.default_rng(seed)
    return [(int(a), int(a + k)) for a, k in zip(rnd.integers(-5, high, n), rnd.integers(0, longest, n))]


def plain_groups(rows):
    """Numbers of overlapping intervals in order, each with its interval."""
    out, end, group = [], None, -1
    for a, b in sorted(rows):
        group += end is None or a > end
        end = b if end is None or a > end else max(end, b)
        out.append((a, b, group))
    return out


def test_merge_and_group_intervals(spark):
    for seed, longest in ((1, 3), (2, 12), (3, 60)):
        rows = random_spans(seed, 70, 400, longest)
        groups = plain_groups(rows)
        merged = [(min(a for a, _, h in groups if h == g), max(b for _, b, h in groups if h == g)) for g in range(groups[-1][2] + 1)]
        for size in (2, 37, 1 << 16):
            got = intervals.merge_intervals(spans(spark, rows), ["chromo"], size).collect()
            assert sorted((r.start, r.end) for r in got) == merged
            got = intervals.group_intervals(spans(spark, rows), ["chromo"], size).collect()
            assert sorted((r.start, r.end, r.group) for r in got) == groups
    assert intervals.merge_intervals(spans(spark, []), ["chromo"]).count() == 0


def test_interval_index_and_distance(spark):
    groups = plain_groups(random_spans(4, 25, 900, 9))
    apart = [(min(a for a, _, h in groups if h == g), max(b for _, b, h in groups if h == g)) for g in range(groups[-1][2] + 1)]
    at = [int(p) for p in np.random.default_rng(5).integers(-20, 950, 150)]
    pos = spark.createDataFrame([("1", p) for p in at] + [("2", 3)], "chromo string, pos int")
    gap = lambda p, a, b: 0 if a <= p <= b else min(abs(p - a), abs(p - b))
    for size in (3, 1 << 16):
        got = intervals.interval_index(pos, spans(spark, apart), ["chromo"], size).collect()
        assert sorted((r.pos, r["index"]) for r in got if r.chromo == "1") == sorted((p, next((i for i, (a, b) in enumerate(apart) if a <= p <= b), -1)) for p in at)
        got = intervals.nearest_interval_distance(pos, spans(spark, apart), ["chromo"], size).collect()
        assert sorted((r.pos, r.distance) for r in got if r.chromo == "1") == sorted((p, min(gap(p, a, b) for a, b in apart)) for p in at)
        assert [r.distance for r in got if r.chromo == "2"] == [None]


def test_intervals_of_all_lengths_hold_what_they_hold(spark):
    """Intervals from one base to a whole chromosome, that overlap at will, against a comparison with each."""
    rnd = np.random.default_rng(7)
    rows = [("t%d" % rnd.integers(3), "1", int(s), int(s + n)) for s, n in zip(rnd.integers(-50, 70_000, 120), 2 ** rnd.uniform(0, 17, 120))] + [(None, "1", 1, 9), ("t1", "2", 5, 5), ("t2", "1", 9, 3)]
    iv = spark.createDataFrame(rows, "track string, chromo string, start int, end int")
    at = sorted({int(p) for p in rnd.integers(-60, 71_000, 300)} | {0, 15, 16, 17, 255, 256})
    got = {(r.pos, r.track): r.flag for r in intervals.annotate_sites(spark.createDataFrame([("1", p) for p in at], "chromo string, pos int"), iv).collect()}
    assert got == {(p, t): int(any(t == a and c == "1" and s <= p <= e for a, c, s, e in rows)) for p in at for t in ("t0", "t1", "t2")}
    none = intervals.annotate_sites(spark.createDataFrame([("1", 3), (None, 3), ("1", None)], "chromo string, pos int"), iv.filter("track = 't0' AND start > 9000")).collect()
    assert [r.flag for r in none] == [0, 0, 0]
    assert intervals.annotate_sites(spark.createDataFrame([("1", 3)], "chromo string, pos int"), iv.limit(0)).count() == 0


def test_extended_intervals_are_long_enough_and_hold_the_old_ones(spark):
    rows = [(max(1, a), max(1, b)) for a, b in random_spans(6, 60, 40, 30)]
    for least in (1, 7, 24):
        got = intervals.extend_intervals(spans(spark, rows), least).withColumn("i", F.monotonically_increasing_id()).orderBy("i").collect()
        for (a, b), r in zip(rows, got):
            missing = max(0, least - (b - a + 1))
            assert r.start == max(1, a - missing // 2) and r.end - r.start + 1 == max(least, b - a + 1) and r.end >= b


@pytest.mark.parametrize("k", [1, 2, 5])
def test_knn(spark, k):
    rnd = np.random.default_rng(k)
    src = {int(a): float(rnd.integers(2)) for a in sorted(rnd.choice(np.arange(3, 60), 14, replace=False))}
    p = spark.createDataFrame([("1", a, "c", v) for a, v in src.items()], "chromo string, pos int, cell string, value double")
    at = sorted({int(a) for a in rnd.integers(0, 66, 20)} | set(list(src)[:3]))
    t = spark.createDataFrame([("1", a, "c") for a in at], "chromo string, pos int, cell string")
    for size in (k + 1, 4096):
        got = {r.pos: r for r in neighbors.knn_neighbors(t, p, k, size, own=True).collect()}
        for a in at:
            left, right = [x for x in src if x < a][-k:], [x for x in src if x > a][:k]
            slots = [None] * (k - len(left)) + left + right + [None] * (k - len(right))
            assert got[a].state == [None if x is None else src[x] for x in slots] and got[a].value == src.get(a)
            assert got[a].dist == [None if x is None else float(abs(x - a)) for x in slots]


def test_knn_and_windows_do_not_depend_on_bins(spark):
    rnd = np.random.default_rng(3)
    rows = [("1", int(p), c, float(rnd.integers(2))) for c in "ab" for p in rnd.choice(3000, 400, replace=False)]
    p = spark.createDataFrame(rows, "chromo string, pos int, cell string, value double")
    grid = sites.map_to_positions(sites.union_positions(p), p)
    one, two = (sorted(map(str, neighbors.knn_neighbors(grid, p, 4, size).collect())) for size in (7, 4096))
    assert one == two
    w = windows.window_stats(grid, p, ["mean", "cov"], [101], 60).select("pos", F.round("mean", 9).alias("mean"), "cov")
    r = windows.range_window_stats(grid, p, ["mean", "cov"], 101).select("pos", F.round("mean", 9).alias("mean"), "cov")
    assert sorted(map(tuple, w.collect()), key=str) == sorted(map(tuple, r.collect()), key=str)


def test_first_rows_equal_one_window(spark):
    rnd = np.random.default_rng(4)
    rows = [("a" if i % 3 else None, i, int(x)) for i, x in enumerate(rnd.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "g string, pos int, x int")
    for n, parts in ((1, 4), (7, 3), (1000, 64)):
        got = first_rows(df, ["g"], [F.desc("x"), F.asc("pos")], n, ["pos"], parts).collect()
        for g in ("a", None):
            want = sorted(((-x, i) for a, i, x in rows if a == g))[:n]
            assert [(-r.x, r.pos) for r in sorted((r for r in got if r.g == g), key=lambda r: r["__rank"])] == want
    assert first_rows(df.limit(0), ["g"], [F.asc("pos")], 3, ["pos"]).count() == 0


def test_feature_table_has_a_row_per_site(spark):
    p = spark.createDataFrame([("1", i * 10, c, float(i % 2)) for i in range(9) for c in "ab" if (i + ord(c)) % 3], "chromo string, pos int, cell string, value double")
    track = spark.createDataFrame([("t", "1", 15, 40)], "track string, chromo string, start int, end int")
    got = features.feature_table(p, ["a", "b"], 2, ["mean"], [21], track).collect()
    assert sorted(r.pos for r in got) == sorted({r.pos for r in p.collect()})
    assert {r.pos for r in got if r.tracks == ["t"]} == {r.pos for r in p.collect() if 15 <= r.pos <= 40}
    assert all(set(r.cells) == {"a", "b"} and len(r.cells["a"].state) == 4 for r in got)


def test_running_equals_one_window(spark):
    rnd = np.random.default_rng(1)
    rows = [("a" if i % 3 else None, i, int(x)) for i, x in enumerate(rnd.integers(0, 50, 200))]
    df = spark.createDataFrame(rows, "g string, pos int, x int")
    for before in (False, True):
        got = {r.pos: r for r in running(df, ["g"], ["pos"], F.floor(F.col("pos") / 13), {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, before).collect()}
        for g, i, x in rows:
            seen = [c for a, b, c in rows if a == g and (b < i or b == i and not before)]
            assert (got[i].s, got[i].m) == (sum(seen), max(seen, default=None))


def test_statistics(spark):
    rows = [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.0), (3, 1.0), (3, 0.0), (4, None)]
    names = ["mean", "mode", "var", "cat_var", "cat2_var", "entropy", "diff", "cov"]
    df = spark.createDataFrame([("1", p, "c", v) for p, v in rows], "chromo string, pos int, cell string, value double")
    got = {r.pos: r for r in sites.site_stats(df, names, 1).collect()}
    assert (got[1].mean, got[1].mode, got[1]["var"], got[1].diff, got[1].cov) == (1, 1, 0, 0, 2)
    assert (got[3].mean, got[3].mode, got[3]["var"], got[3].diff, got[3].cat_var, got[3].cat2_var) == (0.5, 0, 0.25, 1, 2, 1)
    assert abs(got[3].entropy - np.log(2)) < 1e-9 and got[2].entropy < 1e-5 and got[4].cat_var is None and got[4].mean is None
    with pytest.raises(ValueError):
        statistic("median")


def test_arrays(spark):
    row = spark.range(1).select(
        arrays.linear_weights(F.lit(5)).alias("w5"), arrays.linear_weights(F.lit(4)).alias("w4"), arrays.linear_weights(F.lit(1)).alias("w1"),
        arrays.center_slice(F.sequence(F.lit(1), F.lit(7)), 1, True).alias("odd"), arrays.center_slice(F.sequence(F.lit(1), F.lit(6)), 2, False).alias("even"),
        arrays.decode_dna(arrays.encode_dna(F.lit("acgtNx"))).alias("dna"), arrays.encode_dna(F.lit("aTgCn")).alias("codes"),
        arrays.onehot_argmax(arrays.onehot_dna(arrays.encode_dna(F.lit("ATGCN")))).alias("argmax"), arrays.onehot_class(F.lit(1)).alias("cls"),
        arrays.normalized_distances(F.array(F.lit(50000), F.lit(2500), F.lit(None))).alias("dist"),
    ).first()
    assert np.allclose(row.w5, [0.1, 0.55, 1, 0.55, 0.1]) and np.allclose(row.w4, [0.1, 1, 1, 0.1]) and np.allclose(row.w1, [0.1])
    assert row.odd == [3, 4, 5] and row.even == [2, 3, 4, 5] and row.codes == [0, 1, 2, 3, 4] and row.dna == "ACGTN" and row.argmax == [0, 1, 2, 3, 4]
    assert row.cls == [0, 1, 0] and row.dist == [1.0, 0.1, 1.0]


def test_kmers(spark):
    rnd = np.random.default_rng(9)
    seqs = {str(i): "".join(rnd.choice(list("ATGCN"), n, p=[0.24] * 4 + [0.04])) for i, n in enumerate((0, 1, 3, 30, 200))}
    s = spark.createDataFrame(list(seqs.items()), "chromo string, seq string")
    for k in (1, 2, 4):
        for piece in (7, 4096):
            got = {(r.chromo, r.kmer): (r["index"], r.n) for r in dna.kmer_freq(s, k, ["chromo"], piece).collect()}
            expected = {}
            for c, q in seqs.items():
                for x in (q[i : i + k] for i in range(len(q) - k + 1)):
                    if "N" not in x:
                        expected[c, x] = sum("ATGC".index(y) * 4**i for i, y in enumerate(x)), expected.get((c, x), (0, 0))[1] + 1
            assert got == expected
    vector = dna.kmer_vector(dna.kmer_freq(s, 1, ["chromo"]), 1, ["chromo"]).filter("chromo = '4'").first()
    assert vector.counts == [seqs["4"].count(x) for x in "ATGC"]


def test_metrics_by_name(spark):
    p = preds(spark, [(1.0, 0.8), (0.0, 0.3), (1.0, 0.1), (None, 0.9)])
    track = spark.createDataFrame([("t", "1", 0, 1)], "track string, chromo string, start int, end int")
    evaluation.register_metric("Worst", lambda y, z: F.max(F.abs(y - z)))
    got = {(r.anno, r.metric): r.value for r in evaluation.evaluate_by_annotation(p, track, 1, ["worst", "MAE", "kendall", "n"]).collect()}
    assert got["global", "worst"] == 0.9 and abs(got["t", "worst"] - 0.3) < 1e-12 and got["global", "n"] == 3 and abs(got["t", "mad"] - 0.25) < 1e-12
    for bad in (lambda: evaluation.evaluate_by_annotation(p, track, 1, ["acc", "nope"]), lambda: evaluation.register_metric("mae", F.max), lambda: evaluation.curve("lift")):
        with pytest.raises(ValueError):
            bad()


def preds(spark, rows):
    return spark.createDataFrame([("1", i, "cpg/x", y, z) for i, (y, z) in enumerate(rows)], "chromo string, pos int, output string, y double, z double")


def test_metrics_of_odd_groups(spark):
    p = preds(spark, [(1.0, 0.5), (1.0, 0.2), (None, 0.9)])
    r = evaluation.classification(p).first()
    assert (r.tp, r.fn, r.tpr, r.f1, r.mcc, r.tnr, r.prec) == (0, 2, 0, 0, 0, None, None)
    assert evaluation.auc(p).first().auc is None
    assert evaluation.auc(preds(spark, [(1.0, 0.5), (0.0, 0.5)])).first().auc == 0.5
    assert evaluation.auc(preds(spark, [(None, 0.5)])).count() == 0


def test_kendall_against_all_pairs(spark):
    rnd = np.random.default_rng(2)
    y, z = rnd.integers(0, 5, 120).astype(float), rnd.integers(0, 9, 120).astype(float)
    s = [np.sign(y[i] - y[j]) * np.sign(z[i] - z[j]) for i in range(120) for j in range(i)]
    ty, tz = (sum(v[i] != v[j] for i in range(120) for j in range(i)) for v in (y, z))
    rows = preds(spark, list(zip(y.tolist(), z.tolist())))
    got = evaluation.kendall(rows).first().kendall
    assert abs(got - sum(s) / np.sqrt(ty * tz)) < 1e-12
    one = rows.filter("pos = 3").union(rows.filter("pos < 0"))
    assert [r.kendall for r in evaluation.kendall(one).collect()] == [None]
    assert evaluation.kendall(rows.filter("y = 2")).first().kendall is None
    few = evaluation.kendall(rows, most=40)
    assert -1 <= few.first().kendall <= 1 and few.first().kendall != got


def test_kendall_of_continuous_values(spark):
    rnd = np.random.default_rng(5)
    y = rnd.normal(size=300)
    z = y + rnd.normal(size=300)
    s = sum(np.sign(y[i] - y[j]) * np.sign(z[i] - z[j]) for i in range(300) for j in range(i))
    assert abs(evaluation.kendall(preds(spark, list(zip(y.tolist(), z.tolist())))).first().kendall - s / (300 * 299 / 2)) < 1e-12


def test_summary_equals_the_single_metrics(spark):
    rnd = np.random.default_rng(6)
    rows = [(float(rnd.integers(2)), float(rnd.uniform(-0.2, 1.3))) for _ in range(200)] + [(0.25, 0.5), (None, 0.1), (1.0, None)]
    p = preds(spark, rows)
    got = evaluation.summary(p).first()
    seen = [(y, z) for y, z in rows if y is not None and z is not None]
    y, z = np.array(seen).T
    assert got.n == len(seen) and abs(got.mse - ((y - z) ** 2).mean()) < 1e-12 and abs(got.mad - abs(y - z).mean()) < 1e-12 and abs(got.cor - np.corrcoef(y, z)[0, 1]) < 1e-12
    pos, neg = z[np.round(y) == 1], z[np.round(y) == 0]
    area = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert abs(got.auc - area) < 1e-12 and abs(evaluation.auc(p).first().auc - area) < 1e-12
    each = evaluation.classification(p).first()
    assert all(getattr(got, m) == getattr(each, m) for m in ("tp", "tn", "fp", "fn", "acc", "tpr", "tnr", "f1", "mcc"))
    flat = evaluation.summary(preds(spark, [(1.0, 0.3), (1.0, 0.7)])).first()
    assert flat.cor is None and flat.auc is None and flat.n == 2
    assert evaluation.summary(preds(spark, [(None, 0.3)])).count() == 0


def test_shuffles_and_samples_follow_the_key(spark):
    df = spark.createDataFrame([("1", i) for i in range(200)] + [("2", 5), (None, 7)], "chromo string, pos int").repartition(5)
    got = [(r.chromo, r.pos) for r in sites.shuffle_rows(df, ["chromo", "pos"], seed=3).collect()]
    key = lambda r, seed: hashlib.md5("|".join([str(seed), *(str(x) for x in r if x is not None)]).encode()).hexdigest()
    assert got == sorted(got, key=lambda r: key(r, 3)) and len(got) == 202
    some = {(r.chromo, r.pos) for r in sites.sample_per_chromo(df, 10, seed=4).collect()}
    assert some == {("2", 5), (None, 7), *sorted((("1", i) for i in range(200)), key=lambda r: key(r, 4))[:10]}


def test_pca_against_numpy(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(6, 30)) * np.linspace(1, 5, 30)
    rows = spark.createDataFrame([("1", j, i, float(x[i, j])) for i in range(6) for j in range(30)], "chromo string, pos int, filter int, mean double")
    got = np.array([[r.pc1, r.pc2] for r in motifs.activation_pca(rows).orderBy("filter").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.abs(np.abs(got) - np.abs(u[:, :2] * s[:2])).max() < 1e-8


def test_scratch_folders(spark):
    path = staging.scratch_path(spark, "x")
    df = staging.staged(spark.range(5), "numbers")
    assert df.count() == 5 and path.startswith(staging.scratch_dir(spark))
    staging.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0])
    unset = SimpleNamespace(get=lambda key, default: default)
    local, cluster = (SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=m, applicationId=m)) for m in ("local[2]", "spark://host:7077"))
    assert staging.scratch_dir(local) == staging.scratch_dir(local)
    with pytest.raises(ValueError):
        staging.scratch_dir(cluster)

def test_class_and_output_weights(spark):
    rows = spark.createDataFrame([("cpg/a", 1.0)] * 3 + [("cpg/a", 0.0), ("cpg/b", 1.0), ("bulk/c", 0.3), ("cpg/a", None)], "output string, value double")
    w = {(r.output, r["class"]): r.weight for r in weights.class_weights(rows).collect()}
    assert abs(w["cpg/a", 0] - 0.75) < 1e-6 and abs(w["cpg/a", 1] - 0.25) < 1e-6 and w["cpg/b", 0] > 0.999 and ("bulk/c", 0) not in w
    assert min(r.weight for r in weights.sample_weights(rows, weights.class_weights(rows)).filter("value IS NULL").collect()) <= 1e-7
    got = {r.output: r.weight for r in weights.output_weights(rows, ["cpg=2", "cpg/b=3", "ulk=9"]).collect()}
    assert got == {"cpg/a": 2.0, "cpg/b": 3.0, "bulk/c": 1.0}


def test_readers(spark, tmp_path):
    (tmp_path / "cellA.tsv").write_text("# comment\nchr1\t10\t1\n1\t12\t0\nmt\t3\t1\n")
    with gzip.open(tmp_path / "cellB.x.bedGraph.gz", "wt") as f:
        f.write("track type=bedGraph\nchr1\t10\t11\t0.25\nchr2\t5\t6\t0.5\n")
    p = readers.read_profiles(spark, [str(tmp_path / "cellA.tsv"), str(tmp_path / "cellB.x.bedGraph.gz")])
    assert sorted(map(tuple, p.collect())) == [("1", 10, "cellA", 1.0), ("1", 10, "cellB", 0.25), ("1", 12, "cellA", 0.0), ("2", 5, "cellB", 0.5), ("MT", 3, "cellA", 1.0)]
    assert {r.cell: r.is_binary for r in sites.infer_binary(p).collect()} == {"cellA": True, "cellB": False}
    (tmp_path / "bad.tsv").write_text("1\t1\t1.2\n")
    with pytest.raises(ValueError):
        readers.read_profiles(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "pos.tsv").write_text("#c\nchr2\t5\n1\t9\n1\t9\n1\t2\n")
    assert list(map(tuple, readers.read_positions(spark, str(tmp_path / "pos.tsv")).collect())) == [("1", 2), ("1", 9), ("2", 5)]
    (tmp_path / "CGI.bed").write_text("chr1\t1\t5\tx\nchr1\t4\t9\ty\nchr1\t10\t12\tz\n")
    got = readers.read_bed(spark, str(tmp_path / "CGI.bed"), merge=True).orderBy("start").collect()
    assert [tuple(r) for r in got] == [("CGI", "1", 1, 9), ("CGI", "1", 10, 12)]
    (tmp_path / "all" / "cell=a.b").mkdir(parents=True)
    (tmp_path / "all" / "cell=a.b" / "part-0.txt").write_text("1\t4\t1\n")
    assert readers.read_profiles(spark, str(tmp_path / "all")).first().cell == "a.b"


def test_fasta_windows(spark, tmp_path):
    seq = "".join(np.random.default_rng(0).choice(list("ACGTN"), 500))
    (tmp_path / "x.dna.chromosome.2.fa").write_text(">2 dna\n" + "\n\n".join(seq[i : i + 60].lower() for i in range(0, 500, 60)) + "\n")
    tiles = readers.read_fasta(spark, str(tmp_path / "x.dna.chromosome.2.fa"), overlap=10, tile=64)
    at = spark.createDataFrame([("2", p) for p in (1, 3, 64, 65, 200, 499, 500, 501, 0)], "chromo string, pos long")
    padded = "N" * 10 + seq + "N" * 10
    for r in dna.extract_dna_windows(at, tiles, 21, 64).collect():
        assert r.seq == (padded[r.pos - 1 : r.pos + 20] if 1 <= r.pos <= 500 else None)
    (tmp_path / "two.fa").write_text(">a\nAC\n>b\nGT\n")
    with pytest.raises(Exception, match="more than one sequence"):
        readers.read_fasta(spark, str(tmp_path / "two.fa"), single=True).collect()
    (tmp_path / "none.fa").write_text("ACGT\n>b\nGT\n")
    with pytest.raises(Exception, match="without a head line"):
        readers.read_fasta(spark, str(tmp_path / "none.fa")).collect()
    (tmp_path / "chromosome.7.fa").write_text("ACGT\nAC\n")
    assert [(r.chromo, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "chromosome.7.fa")).collect()] == [("7", "ACGTAC")]


def test_fasta_records_over_splits(spark, tmp_path, monkeypatch):
    rnd = np.random.default_rng(7)
    letters = lambda n: "".join(rnd.choice(list("ACGTn"), n))
    files = [{f"chr{k}_{i}": letters(n) for i, n in enumerate((0, 1, 61, 9000, 130, 4000))} for k in range(3)]
    text = lambda seqs, width, end: end.join(f">{h} x{end}" + end.join(q[i : i + width] for i in range(0, len(q), width)) for h, q in seqs.items()) + end
    (tmp_path / "a.fa").write_text(text(files[0], 60, "\n"))
    (tmp_path / "b.fa").write_text(text(files[1], 33, "\n\n"))
    with gzip.open(tmp_path / "c.fa.gz", "wt") as f:
        f.write(text(files[2], 70, "\r\n"))
    monkeypatch.setattr(readers, "PIECE", 200)
    expected = {h.upper().removeprefix("CHR"): q for f in files for h, q in f.items()}
    for size, pieces in (("777b", 10), ("128m", 1)):  # the longest record lies in a dozen splits, or in one
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            tiles = readers.read_fasta(spark, str(tmp_path / "*.fa*"), overlap=37, tile=100).collect()
            assert readers._pieces(spark, str(tmp_path / "a.fa")).select("split").distinct().count() >= pieces
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        found = {(r.chromo, r.tile): (r.start, r.seq, r.n) for r in tiles}
        assert len(found) == len(tiles)
        assert found == {(c, t): (max(0, 100 * t - 37) + 1, q[max(0, 100 * t - 37) : 100 * t + 137], len(q)) for c, q in expected.items() for t in range(max(1, -(-len(q) // 100)))}


def test_motif_files(spark, tmp_path):
    (tmp_path / "db.meme").write_text("MEME version 4\n\nMOTIF M1 (Abc)_x\nmatrix\nURL http://u\n\nMOTIF M2\n\nMOTIF M3 Def\nx MOTIF inside\n")
    names = readers.read_meme_motifs(spark, str(tmp_path / "db.meme"))
    assert sorted(map(tuple, names.collect())) == [("M1", "Abc", "http://u"), ("M3", "Def", "")]
    (tmp_path / "hits.tsv").write_text("#Query ID\tTarget ID\tOptimal offset\tp-value\tE-value\tq-value\tOverlap\nfilter0\tM3\t1\t0.1\t0.2\t0.05\t7\nfilter0\tM1\t1\t0.1\t0.2\t0.05\t7\nfilter2\tM9\t1\t0.1\t0.2\t0.01\t7\n")
    hits = readers.read_motif_hits(spark, str(tmp_path / "hits.tsv"))
    stats = spark.createDataFrame([(0, "ACGT", 2.0), (1, "GGGG", 1.0)], "idx int, motif string, act_mean double")
    report = motifs.motif_report(stats, hits, names)
    assert report.count() == 4 and "query_id" not in report.columns
    top = {r.idx: r.target_id for r in motifs.top_hit_per_filter(report).collect()}
    assert top == {0: "M1", 1: None, 2: "M9"}


def test_writers(spark, tmp_path):
    p = preds(spark, [(None, 0.123456), (1.0, 0.2)])
    writers.write_bedgraph(evaluation.impute(p), str(tmp_path / "bg"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "bg" / "x.bedGraph.gz")).collect()]
    assert lines == ["chr1\t0\t1\t0.12346", "chr1\t1\t2\t1.00000"]
    writers.write_report_tsv(p.select("output", "z"), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), sep="\t", header=True).first().z == "0.12346"
    writers.write_feature_chunks(p, str(tmp_path / "chunks"), 1)
    assert {r.chunk for r in spark.read.parquet(str(tmp_path / "chunks")).collect()} == {0, 1}
    writers.write_predictions(p, str(tmp_path / "preds"))
    assert spark.read.parquet(str(tmp_path / "preds")).count() == 2
    k = spark.createDataFrame([(0, "ACGT")] * 12 + [(1, "AAAA")], "filter int, kmer string")
    pw = motifs.pwm(k)
    assert {r.filter for r in pw.collect()} == {0}
    back = spark.createDataFrame([(c, 0.25) for c in "ACGT"], "nt string, freq double")
    writers.write_meme(pw, back, str(tmp_path / "meme"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "meme")).collect())
    assert "MOTIF filter0\nletter-probability matrix: alength= 4 w= 4 nsites= 12\n1.0000 0.0000 0.0000 0.0000" in text
    writers.write_kmers_fasta(k, str(tmp_path / "kmers"))
    assert spark.read.text(str(tmp_path / "kmers" / "filter=1")).collect()[0].value == ">0"


def test_scan_filters_against_a_loop(spark):
    rnd = np.random.default_rng(4)
    seqs = ["".join(rnd.choice(list("ACGTN"), 21)) for _ in range(5)]
    w = [(f, o, c, float(rnd.normal())) for f in range(3) for o in range(5) for c in "ATGC"]
    wins = spark.createDataFrame([("1", i, s) for i, s in enumerate(seqs)], "chromo string, pos int, seq string")
    got = {(r.pos, r.offset, r.filter): r.act for r in motifs.scan_filters(wins, spark.createDataFrame(w, "filter int, offset int, nt string, weight double")).collect()}
    at = {(f, o, c): x for f, o, c, x in w}
    for i, s in enumerate(seqs):
        for j in range(21):
            for f in range(3):
                act = sum(at.get((f, o, s[j + o - 2]), 0.0) for o in range(5) if 0 <= j + o - 2 < 21)
                assert abs(max(act, 0.0) - got.get((i, j, f), 0.0)) < 1e-9


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fit_output_models_has_all_outputs_and_fits_each(spark):
    from methylspark.plans import adapters, queries

    d = "/root/testdata/sf0.001"
    rows = queries._inputs(spark, d).select("chromo", "pos", "cell", "state", "dist", "value", "weight").toPandas()
    got = queries.QUERIES["fit_output_models"](spark, d).toPandas()
    assert set(got.output) == {f"cpg/{c}" for c in adapters.CELLS} and len(got) == len(rows)
    for cell, own in rows.groupby("cell"):
        x = np.array([[*s, *t] for s, t in zip(own.state, own.dist)], float)
        known = own.value.notna().to_numpy()
        y, w = np.round(own.value[known].astype(float).to_numpy()), own.weight[known].astype(float).to_numpy()
        w = w / w.sum()
        mean = w @ x[known]
        std = np.sqrt(w @ (x[known] - mean) ** 2)
        a = np.c_[(x - mean) / np.where(std > 0, std, 1) * (std > 0), np.ones(len(x))]
        b, ridge = np.zeros(a.shape[1]), np.r_[np.full(a.shape[1] - 1, 0.01), 0]
        for _ in range(50):  # Newton
            p = 1 / (1 + np.exp(-a[known] @ b))
            grad = a[known].T @ (w * (p - y)) + ridge * b
            b -= np.linalg.solve((a[known] * (w * p * (1 - p))[:, None]).T @ a[known] + np.diag(ridge + 1e-9), grad)
        want = dict(zip(zip(own.chromo, own.pos), 1 / (1 + np.exp(-a @ b))))
        z = got[got.output == f"cpg/{cell}"]
        assert max(abs(want[c, p] - v) for c, p, v in zip(z.chromo, z.pos, z.z)) < 2e-6


def test_models_in_blocks_and_of_one_class(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [("1", i, c, [float(x) for x in rnd.normal(size=2)], [float(rnd.normal())], {"a": float(i % 2), "b": 1.0, "c": None}[c], 1.0) for i in range(40) for c in "abc"]
    df = spark.createDataFrame(rows, "chromo string, pos int, cell string, state array<double>, dist array<double>, value double, weight double")
    whole = model.fit_output_models(df, ["a", "b", "c", "d"]).toPandas().sort_values(["output", "pos"])
    assert set(whole[whole.output == "cpg/b"].z) == {1.0} and whole[whole.output == "cpg/c"].z.isna().all() and whole[whole.output == "cpg/a"].z.between(0, 1).all() and len(whole) == 120
    monkeypatch.setattr(model, "MAX_NUMBERS", 30)
    parts = model.fit_output_models(df, ["a", "b", "c"]).toPandas().sort_values(["output", "pos"])
    assert np.allclose(parts.z, whole.z, equal_nan=True)
    assert model.fit_output_models(df.limit(0), []).count() == 0


def test_profile_source(spark, tmp_path):
    rnd = np.random.default_rng(3)
    for c in range(4):
        path = tmp_path / f"cell{c}.x.tsv{'.gz' if c % 2 else ''}"
        with (gzip.open if c % 2 else open)(path, "wt") as f:
            f.write("track type=bedGraph\n" if c >= 2 else "# comment\n")
            for i in range(400):
                site = f"{rnd.choice(['chr1', 'Chr2', 'X'])}\t{rnd.integers(1, 9999)}\t"
                f.write(("#x\n\n" if i % 100 == 7 else "") + site + (f"9\t{rnd.random():.3f}" if c >= 2 else f"{rnd.random():.3f}\textra") + ("\n" if i < 399 else ""))
    (tmp_path / "_hidden").write_text("no")
    expected = readers.read_profiles(spark, str(tmp_path))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for split in (700, 1 << 26):
        assert rows(scan_profiles(spark, str(tmp_path), split=split)) == rows(expected)
    keep = "chromo = '2' AND pos BETWEEN 100 AND 5000 AND cell IN ('cell0', 'cell3') AND value > 0.5"
    found = scan_profiles(spark, str(tmp_path)).filter(keep)
    assert rows(found) == rows(expected.filter(keep)) != []
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert all(x in plan for x in ("EqualTo(chromo,2)", "GreaterThanOrEqual(pos,100)", "LessThanOrEqual(pos,5000)", "In(cell, [cell0,cell3])"))
    assert scan_profiles(spark, f"file://{tmp_path}/cell1*").count() == 400
    (tmp_path / "bad.tsv").write_text("1\t1\t1.2\n")
    with pytest.raises(Exception, match="outside of"):
        scan_profiles(spark, str(tmp_path / "bad.tsv")).collect()
    assert scan_profiles(spark, str(tmp_path / "bad.tsv"), check=False).first().value == 1.2
    (tmp_path / "empty.tsv").write_text("")
    assert scan_profiles(spark, [str(tmp_path / "empty.tsv")]).count() == 0


def test_named_files_and_abort(spark, tmp_path):
    rows = spark.createDataFrame([("b/1:x", 2, "q"), ("a", 1, "p"), ("a", 0, "o")], "name string, i int, t string")
    write = lambda w, folder: w.csv(folder)
    assert sorted(writers.publish_named(rows.filter("name = 'a'"), str(tmp_path / "x"), ".csv", ["i"], write)) == ["a.csv"]
    assert (tmp_path / "x" / "a.csv").read_text() == "0,o\n1,p\n"
    assert {f.name for f in (tmp_path / "x").iterdir() if not f.name.endswith(".crc")} == {"a.csv", "_SUCCESS"}
    for bad in (rows.withColumn("name", F.lit(None).cast("string")), rows.withColumn("t", F.raise_error(F.lit("stop")).cast("string")), rows.filter("name = 'a'"), rows):
        with pytest.raises(Exception):  # no name, a failed task, a name that is there, a name that is no file's
            writers.publish_named(bad, str(tmp_path / "x"), ".csv", ["i"], write)
        assert {f.name for f in (tmp_path / "x").iterdir() if not f.name.endswith(".crc")} == {"a.csv", "_SUCCESS"}
    p = preds(spark, [(None, 0.5), (1.0, 0.2), (0.0, 0.2)])
    assert sorted(writers.write_feature_chunks(p, str(tmp_path / "chunks"), 2)) == ["c1_000000-000002.parquet", "c1_000002-000003.parquet"]
    assert writers.write_bedgraph(evaluation.impute(p).limit(0), str(tmp_path / "none")) == []


def test_site_store_opens_few_files(spark, tmp_path):
    rnd = np.random.default_rng(5)
    rows = [(str(c), int(p), float(v)) for c, p, v in zip(rnd.integers(1, 4, 4000), rnd.integers(1, 10**6, 4000), rnd.random(4000))]
    df = spark.createDataFrame([*rows, (None, 5, 0.5), ("1", None, 0.5)], "chromo string, pos int, value double")
    path = str(tmp_path / "store")
    store.write_site_store(df, path, rows_per_file=100)
    assert store.file_bounds(spark, path).agg(F.sum("rows")).first()[0] == 4002
    files = len(spark.read.parquet(path).inputFiles())
    for region in (("2", 1000, 40_000), ("3", None, 30_000), ("1", 900_000, None), ("2", None, None), ("9", 1, 2), ("1", 5, 4)):
        got = store.read_region(spark, path, *region)
        c, low, high = region[0], region[1] or 0, region[2] or 10**9
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] == c and low <= r[1] <= high)
        assert region[1:] == (None, None) or len(got.inputFiles()) <= 7 < files / 4
    store.write_site_store(df.limit(0), str(tmp_path / "none"))
    assert store.read_region(spark, str(tmp_path / "none"), "1").count() == 0


def test_scores_close_together_fill_all_bins(spark):
    rnd = np.random.default_rng(1)
    n = 4000
    z = np.r_[rnd.random(n // 2) * 1e-4, 1 - rnd.random(n // 2) * 1e-4, np.zeros(300), np.ones(300)]
    y = (rnd.random(len(z)) < 0.2 + 0.6 * z).astype(float)
    p = spark.createDataFrame([("1", i, "cpg/x", float(a), float(b)) for i, (a, b) in enumerate(zip(y, z))], "chromo string, pos int, output string, y double, z double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few small bins become one
    depths = [r["count"] for r in equi_depth(evaluation._scores(p, ["output"]), ["output"], "z").groupBy("__b").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(depths) >= 3 and max(depths) <= 2 * sum(depths) / len(depths)
    above = sum(((b < z).sum() + (b == z).sum() / 2) for b in z[y == 0])
    pairs = sum((z[y == 1] > b).sum() + (z[y == 1] == b).sum() / 2 for b in z[y == 0])
    assert abs(evaluation.auc(p).first().auc - pairs / ((y == 1).sum() * (y == 0).sum())) < 1e-12 and above > 0
    roc = evaluation.roc_curve(p).orderBy("x", "y").collect()
    order = np.unique(z)[::-1]
    assert len(roc) == len(order) + 1 and [round(r.y * (y == 1).sum()) for r in roc[1:]] == [int(((z >= t) & (y == 1)).sum()) for t in order]


def test_categories_of_four_classes_and_unknown_names(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(200):
        label = int(rnd.integers(0, 4))
        rows.append((i, "cpg_stats/cat_var", None, None, [float(k == label) for k in range(4)] if i % 20 else None, [float(x) for x in rnd.random(4).round(1)]))
        rows.append((i, "cpg/x", float(label % 2), float(rnd.random()), None, None))
    p = spark.createDataFrame(rows, "pos int, output string, y double, z double, y_classes array<double>, z_classes array<double>").withColumn("chromo", F.lit("1"))
    got = {(r.output, r.metric): r.value for r in evaluation.evaluate_outputs(p).collect()}
    own = [(np.array(r[4]), np.array(r[5])) for r in rows if r[4]]
    assert got["cpg_stats/cat_var", "n"] == len(own) and abs(got["cpg_stats/cat_var", "cat_acc"] - np.mean([a.argmax() == b.argmax() for a, b in own])) < 1e-12
    for k in range(4):
        pos, neg = [b[k] for a, b in own if a[k]], [b[k] for a, b in own if not a[k]]
        area = sum((x > w) + (x == w) / 2 for x in pos for w in neg) / (len(pos) * len(neg))
        assert abs(got["cpg_stats/cat_var", f"auc_{k}"] - area) < 1e-12
    assert {m for o, m in got if o == "cpg/x"} == {"auc", "acc", "tpr", "tnr", "f1", "mcc", "n"}
    wide = evaluation.categorical(p.filter("y_classes IS NOT NULL").select("output", F.col("y_classes").alias("y"), F.col("z_classes").alias("z"))).first()
    assert abs(wide.auc_3 - got["cpg_stats/cat_var", "auc_3"]) < 1e-12
    with pytest.raises(Exception, match="no metrics are known"):
        evaluation.evaluate_outputs(p.withColumn("output", F.lit("other/x"))).collect()
    with pytest.raises(Exception, match="y_classes"):
        evaluation.evaluate_outputs(p.drop("y_classes")).collect()
    blocks = evaluation.chunked_evaluation(p.filter("output = 'cpg/x'"), F.expr("pos div 50"))
    each = [evaluation.auc(p.filter(f"output = 'cpg/x' AND pos div 50 = {b}")).first().auc for b in range(4)]
    assert abs({r.metric: r.value for r in blocks.collect()}["auc"] - np.mean(each)) < 1e-12


def test_feature_table_joins_buckets_without_exchange(spark):
    rnd = np.random.default_rng(4)
    rows = [(str(c), int(p), cell, float(rnd.integers(0, 2))) for c in (1, 2) for p in range(0, 600, 7) for cell in "ab" if rnd.random() < 0.7]
    p = spark.createDataFrame(rows, "chromo string, pos int, cell string, value double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = features.feature_table(p, ["a", "b"], 3, ["mean", "var"], [21, 101])
    got = t.collect()
    plan = t._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    stats = {(r.chromo, r.pos, r.wlen): r for r in windows.window_stats(sites.map_to_positions(p.select("chromo", "pos").distinct(), p), p, ["mean", "var"], [21, 101], 3).collect()}
    own = {(r.chromo, r.pos): r for r in sites.site_stats(p, ["mean", "var"]).collect()}
    assert len(got) == len(own)
    for r in got:
        assert (r.mean, r["var"]) == (own[r.chromo, r.pos].mean, own[r.chromo, r.pos]["var"])
        assert all(abs(r[f"win_{n}_mean"] - stats[r.chromo, r.pos, n].mean) < 1e-12 and abs(r[f"win_{n}_var"] - stats[r.chromo, r.pos, n]["var"]) < 1e-12 for n in (21, 101))
    names = [r.tableName for r in spark.sql("SHOW TABLES").collect()]
    staging.clear(spark)
    assert names and not spark.sql("SHOW TABLES").collect()


def test_ranks_from_the_top_without_sorting(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    values = {0: rnd.random(3000), 1: np.round(rnd.random(3000), 1) + 0.1, 2: np.full(500, 2.0), 3: rnd.exponential(1, 50), 4: np.r_[np.full(2000, 0.5), rnd.random(30)]}
    acts = spark.createDataFrame([(f, i, float(x)) for f, v in values.items() for i, x in enumerate(v)], "filter int, pos int, act double").cache()
    for bracket, ranks in ((20, {0: 1000, 1: 700, 2: 17, 3: 50, 4: 12}), (20, {0: 1, 1: 3000, 2: 500, 3: 2, 4: 2025}), (1 << 16, {0: 2999, 1: 1, 4: 1})):
        monkeypatch.setattr(motifs, "BRACKET", bracket)
        got = motifs.ranked_from_top(acts, ranks)
        top = {f: np.sort(values[f])[::-1] for f in ranks}
        assert got == {f: (top[f][r - 1], top[f][max(r - 2, 0)]) for f, r in ranks.items()}
    assert motifs.ranked_from_top(acts, {}) == {}


def test_sample_by_threshold_is_the_full_ranking(spark, monkeypatch):
    df = spark.createDataFrame([(c, i) for c, n in (("1", 3000), ("2", 40), (None, 500), ("X", 1)) for i in range(n)], "chromo string, pos int")
    full = first_rows(df, ["chromo"], [sites.shuffle_key(["chromo", "pos"], 9), F.col("chromo"), F.col("pos")], 50, ["chromo", "pos"])
    rows = lambda x: sorted(map(tuple, x.select("chromo", "pos").collect()), key=str)
    expected = rows(full)
    assert len(expected) == 50 + 40 + 50 + 1 and rows(sites.sample_per_chromo(df, 50, 9)) == expected
    real = F.conv  # hashes that seem larger than they are: too few pass, so all are ranked
    monkeypatch.setattr(sites.F, "conv", lambda *x: real(*x) * 100)
    assert rows(sites.sample_per_chromo(df, 50, 9)) == expected
    monkeypatch.undo()
    assert sites.sample_per_chromo(df.limit(0), 50).count() == 0


def test_logistic_by_a_tree_of_sums(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    x, w = rnd.normal(size=(400, 3)), rnd.random(400) + 0.5
    y = (rnd.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(float)
    df = spark.createDataFrame([("c" if i % 2 else "d", [float(v) for v in x[i]], float(y[i]), float(w[i])) for i in range(400)], "cell string, x array<double>, y double, weight double").repartition(9)
    monkeypatch.setattr(model, "FAN_IN", 2)
    got = model.fit_logistic(df, 3)
    for cell, own in (("c", np.arange(1, 400, 2)), ("d", np.arange(0, 400, 2))):
        mean = w[own] @ x[own] / w[own].sum()
        scale = 1 / np.sqrt(w[own] @ x[own] ** 2 / w[own].sum() - mean**2)
        a, b = np.c_[(x[own] - mean) * scale, np.ones(len(own))], np.zeros(4)
        for _ in range(50):  # Newton's method on all rows at once
            z = 1 / (1 + np.exp(-a @ b))
            v = w[own] / w[own].sum()
            b = b - np.linalg.solve((a * (v * z * (1 - z))[:, None]).T @ a + np.diag([0.01] * 3 + [0]), a.T @ (v * (z - y[own])) + np.r_[0.01 * b[:3], 0])
        assert np.allclose(got[cell][0], b[:3] * scale, atol=1e-7) and abs(got[cell][1] - (b[3] - b[:3] @ (mean * scale))) < 1e-7


def test_unknown_letters_are_filled_alike(spark):
    seq = "NNACGTNRNNACCNNTTGNN"
    at = spark.createDataFrame([("1", p) for p in range(1, 21)] + [("2", 5)], "chromo string, pos long")
    tiles = dna.cut_tiles(spark.createDataFrame([("1", seq), ("2", seq)], "chromo string, seq string"), 8, 8)
    found = {}
    for r in dna.fill_unknown(dna.extract_dna_windows(at, tiles, 7, 8)).collect():
        for i, x in enumerate(r.seq):
            found.setdefault((r.chromo, r.pos - 3 + i), set()).add(x)
    assert all(len(v) == 1 and v <= set("ATGC") for v in found.values())
    assert all(found["1", i + 1] == {x} for i, x in enumerate(seq) if x in "ATGC")
    assert len({next(iter(found["1", p])) for p in (1, 2, 7, 8, 9, 10, 14, 15, 19, 20)}) > 1


def test_fasta_query_writes_files_of_many_records(spark, tmp_path):
    from methylspark.plans import files

    spark.createDataFrame([(i, "acgt cg" * (i % 40)) for i in range(300)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = files.read_fasta(spark, str(tmp_path))
    assert got.select("chromo").distinct().count() == 300
    written = {r[0] for r in spark.read.parquet(*[f.rsplit("/", 1)[0] for f in got.inputFiles()[:1]]).select("file").distinct().collect()}
    assert len(written) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_activation_counts_stand_for_activations(spark):
    import random

    rng = random.Random(3)
    wins = spark.createDataFrame([("1", i, "".join(rng.choice("ATGCN") for _ in range(21))) for i in range(700)], "chromo string, pos long, seq string").repartition(5)
    w = spark.createDataFrame([(f, o, c, rng.randint(-9, 9) / 10) for f in range(3) for o in range(4) for c in "ATGC"], "filter int, offset int, nt string, weight double")
    acts = motifs.scan_filters(wins, w, digits=6).filter("act > 0").cache()
    counts = motifs.activation_counts(wins, w, digits=6)
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in acts.groupBy("filter", "act").count().collect()}
    n = 700 * 21
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(motifs.activation_histogram(counts, 0.0, 2.0, 5)) == rows(motifs.activation_histogram(acts, 0.0, 2.0, 5))
    for most in (1, 50, 2000, n):
        assert rows(motifs.activation_threshold(counts, n, 0.9, most)) == rows(motifs.activation_threshold(acts, n, 0.9, most))


def test_rounded_activations_tie_with_the_threshold(spark):
    # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in the last bit; both reach the threshold
    weights = {0: (0.1, 0.3), 1: (0.2, 0.2), 2: (0.3, 0.1)}
    w = spark.createDataFrame([(0, o, c, x) for o, (p, q) in weights.items() for c, x in (("A", p), ("T", q), ("G", 0.0), ("C", 0.0))], "filter int, offset int, nt string, weight double")
    wins = spark.createDataFrame([("1", i, f"GGGG{x}GGGG") for i, x in enumerate(["AAA", "TTT"] * 10)], "chromo string, pos long, seq string")
    thresholds = spark.createDataFrame([(0, 0.6)], "filter int, threshold double")
    assert motifs.scan_filters(wins, w, digits=6, above={0: 0.6}).count() == 20
    assert features.activating_kmers(wins, w, thresholds, 3).count() == 20


def test_counted_predictions_give_the_metrics_of_all_rows(spark):
    rows = [("1", i, "cpg_stats/mean", [0.0, 0.5, 1.0, None][i % 4], (i * 7 % 5) / 4) for i in range(400)]
    preds = spark.createDataFrame(rows, "chromo string, pos long, output string, y double, z double")
    counts = evaluation.counted(preds)
    assert counts.count() == 20 and counts.agg(F.sum(evaluation.TIMES)).first()[0] == 400
    for of in (evaluation.summary, evaluation.kendall, evaluation.auc):
        (one,), (other,) = of(preds).collect(), of(counts).collect()
        assert list(one[1:]) == pytest.approx(list(other[1:]))
    tracks = spark.createDataFrame([("t", "1", 0, 99), ("t", "1", 50, 199), ("few", "1", 3, 4)], "track string, chromo string, start long, end long")
    got = {r.anno: r.n for r in evaluation.annotated_counts(preds, tracks, 20).groupBy("anno").agg(F.sum(evaluation.TIMES).alias("n")).collect()}
    assert got == {"global": 400, "t": 200}


def test_index_of_sites_is_that_of_every_point(spark):
    at = spark.createDataFrame([("1", p) for p in range(30)] + [("2", 5)], "chromo string, pos long")
    iv = spark.createDataFrame([("a", "1", 2, 4), ("a", "1", 9, 20), ("b", "1", 4, 4), ("b", "2", 5, 9)], "track string, chromo string, start long, end long")
    points = at.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("track"))
    rows = lambda df: sorted(tuple(r) for r in df.select("chromo", "pos", "track", "index").collect())
    assert rows(intervals.index_of_sites(at, iv)) == rows(intervals.interval_index(points, iv, ["track", "chromo"]))


def test_targets_that_are_the_whole_profile_need_no_join(spark):
    grid = spark.createDataFrame([("1", p, c, None if p % 3 == i else float(p % 2)) for p in range(40) for i, c in enumerate("xy")], "chromo string, pos long, cell string, value double").cache()
    rows = lambda df: sorted(map(str, df.collect()))
    alone = neighbors.knn_neighbors(grid, None, 2, own=True)
    assert rows(alone) == rows(neighbors.knn_neighbors(grid, grid, 2, own=True))
    w = alone.withColumn("weight", F.lit(2.0))
    labels = grid.withColumn("weight", F.lit(2.0))
    assert rows(model.build_model_input(w, own=True)) == rows(model.build_model_input(alone.drop("value"), labels=labels))
