"""Held-out accuracy of the learned operators, recall of the index, and the mixing targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries as Q
from tidemark.llm.components import components
from tidemark.llm.embedding_dedup import near_duplicates
from tidemark.llm.language_id import fit_language, identify_language
from tidemark.llm.mixing import mix_to_targets, solve
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.llm.toxicity import Automaton, choose_terms, fit_toxicity, score_toxicity

DATA = "/root/testdata/sf0.1"


def odd(spark, label="toxic"):
    rows = [(1, None, "en"), (2, "", "en"), (2, "", "en"), (None, "hello there you", None), (3, "12 34 !!", "de"), (4, "word " * 30000, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")


def test_language_held_out_accuracy(spark):
    docs = Q.table(spark, DATA, "documents")
    got = Q.op6_language_id(spark, DATA).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_quality_held_out_accuracy(spark):
    got = Q.op9_quality_classifier(spark, DATA).where("held_out").join(Q.table(spark, DATA, "labels"), "doc_id")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.97


def test_toxicity_held_out_accuracy(spark):
    got = Q.op5_toxicity(spark, DATA).where("held_out").join(Q.table(spark, DATA, "labels"), "doc_id")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).first()
    assert r.recall > 0.75 and r.wrong < 0.01


def test_odd_rows_of_the_classifiers(spark):
    docs, labels = odd(spark)
    tox = score_toxicity(docs, fit_toxicity(docs, labels))
    qual = score_quality(docs, fit_quality(docs, labels))
    lang = identify_language(docs, fit_language(docs))
    for df in (tox, qual, lang):
        assert df.count() == 6 and df.where("score is null or score < 0 or score > 1").count() == 0
        assert df.where("doc_id is null and not held_out").count() == 0
    assert {(r.doc_id, r.lang_pred) for r in lang.where("doc_id in (1, 2, 3)").collect()} == {(1, "und"), (2, "und"), (3, "und")}
    none = docs.limit(0)
    assert score_toxicity(none, fit_toxicity(none, labels)).count() == 0
    assert identify_language(none, fit_language(none)).count() == 0
    assert score_quality(none, fit_quality(none, labels)).count() == 0


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_automaton_equals_edit_distance():
    import random

    from tidemark.llm.bytetext import ALNUM, Slice

    rng = random.Random(2)
    terms = [b"pathetic", b"moron", b"worthless", b"patents", b"lowe*"]
    words = []
    for _ in range(3000):
        w = list(rng.choice(terms).rstrip(b"*").decode())
        for _ in range(rng.randrange(0, 3)):
            p, c = rng.randrange(len(w) + 1), rng.choice("aeptz")
            rng.choice([lambda: w.insert(p, c), lambda: w.__setitem__(min(p, len(w) - 1), c), lambda: w.pop(min(p, len(w) - 1)) if len(w) > 1 else None])()
        words.append("".join(w))
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    kind = Automaton(terms).run(Slice(raw, np.array([0, len(raw)]), 0, ALNUM, True))
    plain = [t.decode() for t in terms if not t.endswith(b"*")]
    for w, k in zip(words, kind, strict=True):
        want = 3 if w.startswith("lowe") else 1 if w in plain else 2 if any(len(t) >= 6 and edits(w, t) == 1 for t in plain) else 0
        assert k == want, w


def test_chosen_terms_allow_edits():
    """Terms and automaton together: misspellings of words that a stem begins are found, clean words with their first letters are not."""
    from tidemark.llm.bytetext import ALNUM, Slice

    toxic = {b"pathetic": 60, b"worthless": 50, b"stupid": 50, b"graxer": 20, b"graxify": 15, b"graxible": 12}
    counts = {w: (n, 0) for w, n in toxic.items()}
    for w, n in toxic.items():
        for k in range(4, 8):
            stem = w[:k] + b"*"
            counts[stem] = (counts.get(stem, (0, 0))[0] + n + n // 4, 0)
    terms = choose_terms(counts, 8, 0.97)
    assert set(toxic) <= set(terms) and {t for t in terms if t.endswith(b"*")} == {b"grax*"}
    want = {"pathetic": 1, "pethetic": 2, "patetic": 2, "wrthless": 2, "worthlesss": 2, "ptupid": 2, "stupit": 2, "graxwort": 3, "pathway": 0, "patents": 0, "worthy": 0, "stupor": 0}
    raw = np.frombuffer(" ".join(want).encode(), dtype=np.uint8)
    kind = Automaton(terms).run(Slice(raw, np.array([0, len(raw)]), 0, ALNUM, True))
    assert dict(zip(want, kind.tolist(), strict=True)) == want
    many = [b"abcdef" + bytes([97 + i // 26, 97 + i % 26]) * 2 for i in range(150)]
    last = many[-1].replace(b"abc", b"axc")
    raw = np.frombuffer(last, dtype=np.uint8)
    assert Automaton(many).run(Slice(raw, np.array([0, len(raw)]), 0, ALNUM, True)).tolist() == [2]


def test_misspelled_terms_are_hit_by_the_operator(spark):
    """Misspellings that no training text holds, of words the lexicon has learned."""
    import random
    import zlib

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    words, insults = [word() for _ in range(200)], ["pathetic", "worthless", "scumbag", "imbecile"]
    text = lambda extra: " ".join(rng.choice(words) for _ in range(20)) + f" you {extra} " + " ".join(rng.choice(words) for _ in range(20))
    rows = [(i, text(rng.choice(insults) if i % 3 == 0 else rng.choice(words)), int(i % 3 == 0)) for i in range(900)]
    held = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 5 == 0][:24]
    for n, i in enumerate(held):
        w = insults[n % 4]
        p = 1 + n % (len(w) - 2)
        rows.append((i, text([w[:p] + "x" + w[p + 1 :], w[:p] + w[p + 1 :], w[:p] + "x" + w[p:]][n % 3]), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(df.drop("toxic"), fit_toxicity(df.drop("toxic"), df.drop("text"))).collect()}
    assert sum(got[i] for i in held) >= 22
    assert sum(got[i] for i, _, y in rows if not y) == 0


def test_scores_equal_a_plain_sum_over_subwords(spark):
    from tidemark.llm.bytetext import LOWER
    from tidemark.llm.language_id import SIZES, buckets

    docs = Q.table(spark, "/root/testdata/sf0.001", "documents")
    model = fit_language(docs)
    rows = [(i, t) for i, t in enumerate(["Hello there", "ab", "x " * 3000, "überall schöne Grüße", "¿dónde está?"])]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        data = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
        grams = [int(buckets(data[k : k + n], n)[0]) for n in SIZES for k in range(len(data) - n + 1)]
        z = (sum((model.table[g].astype(float) for g in grams), np.zeros(len(model.languages))) / max(1, len(grams)) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i][0] == model.languages[int(p.argmax())] and got[i][1] == pytest.approx(float(p.max()), rel=1e-4)


def test_huge_vectors_repeated_ids_and_clashing_columns(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [2e200, 2e200], 0), (3, [1e-200, -1e-200], 0), (4, [3e-300, -3e-300], 0), (5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [0.0, 1.0], 0)]
    got = {}
    for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, weight long").withColumnRenamed("weight", "component")).collect():
        got.setdefault(r.vec_id, set()).add((r.n_links, r.component_id, r.kept))
    assert got == {1: {(1, 1, True)}, 2: {(1, 1, False)}, 3: {(1, 3, True)}, 4: {(1, 3, False)}, 5: {(1, 5, True)}, 6: {(1, 5, False)}}


def test_near_duplicates_recall_and_components(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 16))
    near = base[rng.integers(0, 60, 500)] + rng.normal(size=(500, 16)) * 0.12
    x = np.concatenate([base, near, base[:20], base[:10] * 3])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, 2.0]), (5004, [None] * 16), (None, [1.0] * 16)]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    z = np.array([np.float32(r).astype(float) for r in x])
    z /= np.linalg.norm(z, axis=1)[:, None]
    links = z @ z.T >= 0.9
    np.fill_diagonal(links, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.9 * links.sum() <= found <= links.sum()
    assert all(got[i].n_links <= links[i].sum() for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(5000, 5005))
    assert got[None].n_links == 0 and got[None].kept is False
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_mixing_meets_reachable_targets(spark):
    rows = [(i, ("WORD " if i % 2 else "word ") * (20 + i % 30), "s") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (None, "word", "s"), (3, "WORD word", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = docs.where("doc_id < 300").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 1, "loud").otherwise("calm").alias("domain"))
    out = mix_to_targets(docs, known, {"loud": 1.0, "calm": 3.0}).cache()
    assert out.count() == len(rows) and out.where("rate < 0 or rate is null").count() == 0
    s = out.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("expected_tokens") * F.col(f"p_{d}")).alias(d) for d in ("loud", "calm"))).first()
    assert s.loud / s.n == pytest.approx(0.25, abs=1e-3) and s.calm / s.n == pytest.approx(0.75, abs=1e-3)
    assert mix_to_targets(docs.limit(0), known.limit(0), {"a": 1.0, "b": 1.0}).count() == 0


def test_rates_equal_a_plain_solution(spark):
    """The nearest nonnegative rates to one under the domains' totals, by brute force in numpy on the same posteriors."""
    docs = Q.table(spark, "/root/testdata/sf0.01", "documents")
    out = mix_to_targets(docs, Q.labelled_domains(spark, "/root/testdata/sf0.01"), Q.TARGETS).toPandas()
    assert out.residual.nunique() == 1 and out.residual[0] <= 1e-6
    x = out[[f"p_{d}" for d in sorted(Q.TARGETS)]].to_numpy() * out.n_tokens.to_numpy(float)[:, None] / out.n_tokens.sum()
    target = np.array([Q.TARGETS[d] for d in sorted(Q.TARGETS)])
    assert np.abs(x.T @ out.rate.to_numpy() - target).max() <= 2e-6 and (out.rate >= 0).all()
    r = np.ones(len(x))
    for _ in range(4000):  # projected gradient in the plain metric
        r = np.maximum(0, r - x @ (x.T @ r - target) / np.linalg.norm(x, 2) ** 2)
    assert np.linalg.norm(x.T @ out.rate.to_numpy() - target) <= np.linalg.norm(x.T @ r - target) + 1e-6


def test_posteriors_on_held_out_labels(spark):
    docs = Q.table(spark, DATA, "documents")
    known = Q.labelled_domains(spark, DATA).where("domain is not null")
    out = mix_to_targets(docs, known.where(F.col("id") % 4 != 0), Q.TARGETS)
    best = F.array_sort(F.array(*[F.struct((-F.col(f"p_{d}")).alias("p"), F.lit(d).alias("d")) for d in Q.TARGETS]))[0]["d"]
    r = out.join(known.where(F.col("id") % 4 == 0), F.col("doc_id") == F.col("id")).agg(F.avg((best == F.col("domain")).cast("double"))).first()
    assert r[0] > 0.75


def test_small_system():
    assert np.allclose(solve([[2.0, 1.0], [1.0, 3.0]], [3.0, 5.0]), [0.8, 1.4])


def test_pipeline_stages_take_effect(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    docs = Q.table(spark, "/root/testdata/sf0.001", "documents")
    passage = Q.table(spark, "/root/testdata/sf0.001", "benchmark").orderBy("item_id").first().text
    text = " ".join(word() for _ in range(120))
    extra = [(90001, text, "en", "x", 1), (90002, text.replace(text.split()[50], "changed"), "en", "x", 1), (90003, " ".join(word() for _ in range(60)) + " " + passage, "en", "x", 1), (90004, " ".join(word() for _ in range(60)) + " password = abcdef123456", "en", "x", 1), (90005, None, None, None, None)]
    more = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept, seen = more, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, "/root/testdata/sf0.001"), name)
        assert kept.columns == docs.columns
        seen.append({r.doc_id for r in kept.select("doc_id").collect()})
    ids = seen[-1]
    assert 90001 in ids and 90002 not in ids and 90003 not in ids and 90004 in ids and 90005 in ids
    assert kept.where("doc_id = 90004").first().text.endswith("[SECRET]")
    last = corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001")
    assert {r.doc_id for r in last.collect()} == ids


def test_pipeline_stages_on_empty_tables_and_clashing_columns(spark):
    docs = Q.table(spark, "/root/testdata/sf0.001", "documents")
    odd_docs = docs.limit(30).withColumns({"n": F.lit(1), "__spans": F.lit("s"), "id": F.lit("x"), "key": F.lit("k"), "component_id": F.lit(3)})
    for df in (docs.limit(0), odd_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "/root/testdata/sf0.001")
            assert name == "mixing" or out.columns == df.columns
            assert out.count() <= df.count()
