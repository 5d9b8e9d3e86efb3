import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
from rinsework.llm import quality

WORDS = "the of and to in is it that was for on are with as his they at be this from have or by one had not but what all".split()
LABELS = "doc_id long, quality int, toxic int"


def _good(r):
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(r.randint(5, 12))).capitalize() + "." for _ in range(r.randint(1, 9)))


def _bad(r):
    w = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
    return r.choice((lambda: " ".join(x.upper() + "!!" for x in w), lambda: " | ".join(w), lambda: " ".join(x for x in w for _ in range(9)),
                     lambda: " ".join(x + "$$$" for x in w)))()


def _corpus(n, bad_share, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < bad_share
        rows.append((i, _bad(r) if bad else _good(r)))
        if r.random() < 0.5:
            labels.append((i, int(not bad), 0))
    return rows, labels


def _out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.mark.parametrize("bad_share", [0.1, 0.5])
def test_learns_from_good_and_unlabelled_texts(spark, staging, documents, bad_share):
    rows, labels = _corpus(2500, bad_share, 3)
    truth = {i: q for i, q, _ in labels}
    # labels of bad texts, and all labels of held-out rows, teach nothing: wrong ones there change nothing
    misled = [(i, q if q and not _out(i) else 0, t) for i, q, t in labels]
    measured = staging.write(quality.measured(documents(*rows)), "measured")
    net, prior = quality.fit(measured, quality.trusted(spark.createDataFrame(misled, LABELS)))
    assert abs(prior - (1 - bad_share)) < 0.06
    got = quality.score(measured, net).collect()
    assert all(r["held_out"] == _out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    tested = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    wrong = [t for t in tested if t[0] != t[1]]
    assert len(wrong) <= 0.03 * len(tested), (prior, len(tested), wrong)


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in contract.queries()["op11_quality"](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for label, least in ((1, 0.99), (0, 0.97)):
        tested = [got[i]["predicted"] == label for i, q in truth.items() if q == label and got[i]["held_out"]]
        assert len(tested) > 100 and sum(tested) / len(tested) >= least, (label, sum(tested) / len(tested))


def test_odd_rows(spark, staging):
    r = random.Random(1)
    rows = [(i, _good(r), "x", 1) for i in range(80)]
    rows += [(100, None, "x", 1), (101, "", "y", 2), (None, "no id", "z", 3), (102, "same text", "a", 0), (103, "same text", "b", 9),
             (104, "x" * 200_000, "a", 0), (105, " \n\t\n ", "a", 0), (106, "😀퟿日本 語", "a", 0), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m string, score int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (41, None, 0), (0, 0, 0), (1, 1, 1)], LABELS)
    got = quality.classify(docs, labels, staging)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert sorted(str(x["doc_id"]) for x in found) == sorted(str(x[0]) for x in rows)
    by_id = {x["doc_id"]: x["score"] for x in found}
    assert by_id[100] == by_id[101] and by_id[102] == by_id[103]
    trusted = {x["doc_id"] for x in quality.trusted(labels).collect()}
    assert trusted == {i for i in range(1, 40) if not _out(i)}
    again = {x["doc_id"]: x["score"] for x in quality.classify(docs.repartition(7), labels, staging).collect()}
    assert again == by_id  # reruns agree


def test_nothing_to_learn(spark, staging, documents):
    labels = spark.createDataFrame([(1, 0, 0)], LABELS)
    docs = documents((1, "a text"), (2, None))
    assert {r["score"] for r in quality.classify(docs, labels, staging).collect()} == {0.0}
    assert quality.classify(docs.limit(0), labels.limit(0), staging).collect() == []


def test_slopes_follow_the_risk():
    r = np.random.default_rng(0)
    for prior, shift, bounded in ((0.4, 0.0, True), (0.9, -3.0, True), (0.4, 0.0, False), (0.9, -3.0, False)):
        good, open_ = r.normal(0, 1, 7), r.normal(shift, 1, 9)

        def objective(good, open_):
            positive, negative, _ = quality.risk(good, open_, prior, bounded)
            return positive + negative if negative >= 0 else -negative

        slopes = quality.risk(good, open_, prior, bounded)[2]
        assert (quality.risk(good, open_, prior, bounded)[1] < 0) == (shift < 0)
        for which, slope in enumerate(slopes):
            for i in range(len(slope)):
                moved = [good.copy(), open_.copy()]
                moved[which][i] += 1e-6
                assert abs((objective(*moved) - objective(good, open_)) / 1e-6 - slope[i]) < 1e-4


def test_network_gradients():
    r = np.random.default_rng(1)
    rows = r.normal(size=(5, 4))
    net = quality.Network.fresh(rows)
    x = net.inputs(rows)
    z, hidden = net.logits(x)
    slope = r.normal(size=5)
    found = net.gradients(x, hidden, slope)
    for k, w in net.weights.items():
        at = (0,) * w.ndim
        w[at] += 1e-6
        after = net.logits(x)[0]
        w[at] -= 1e-6
        assert abs(((after - z) * slope).sum() / 1e-6 - found[k][at]) < 1e-4


def test_measures():
    names = quality.SHAPE
    got = quality.measures(pa.array(["AB ab ab!!\nx", "", "a\na"]))
    row = dict(zip(names, got[0].tolist()))
    assert row["words repeated at once"] == 0 and row["distinct words"] == 1 and row["words in capitals"] == 0.25
    assert row["words ending in signs"] == 0.25 and abs(row["letters"] - 5 / 12) < 1e-6 and row["distinct lines"] == 1
    assert not got[1].any() and dict(zip(names, got[2].tolist()))["distinct lines"] == 0.5
    assert got.shape[1] == len(names) + quality.BUCKETS
