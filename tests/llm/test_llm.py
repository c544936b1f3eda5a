import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import history, mixing, scans, splitting, tokenize, truncation, unify, vectors

# ---- new batches against history


def _near(rows, s=0.7):
    """Batch by batch, against every accepted row."""
    kept, out = {}, set()
    for batch, key, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0], r[1])):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        sh = frozenset(zip(w, w[1:], w[2:]))
        if not sh:
            continue
        hits = [k for k, t in kept.items() if len(sh & t) >= s * len(sh | t) - 1e-9]
        if hits:
            out.add((min(hits), key))
        else:
            kept[key] = sh
    return out


def _texts(seed, n=150):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    rows, base = [], [[rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 12, 40]))] for _ in range(25)]
    for key in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if rnd.random() < 0.2:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        rows.append((rnd.choice([1, 2, 3, 4]), key * 7 % 1009, rnd.choice([" ", ", ", "\n"]).join(w)))
    rows += [(1, 2000, None), (1, 2001, ""), (2, 2002, "one two"), (None, 2003, rows[0][2]), rows[3], rows[3], (5, 2004, "tail " * 30000), (5, 2005, "tail " * 29999), (6, 2006, "ß é 1a " * 9)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_repeats_against_all_accepted(spark, seed):
    rows = _texts(seed)
    df = spark.createDataFrame(rows, "batch int, id long, text string").selectExpr("*", "1 AS key", "2 AS class", "3 AS n", "4 AS symbol")
    got = {tuple(r) for r in history.near_repeats(df, "id", "batch", "text").collect()}
    assert got == _near(rows)


def test_batch_by_batch_gives_the_same(spark, tmp_path):
    """Each batch through a new object on the same folder; the third is tried twice."""
    rows = [r for r in _texts(3) if r[0] is not None]
    folder, got = f"file://{tmp_path}/accepted", set()
    for turn, b in enumerate(sorted({r[0] for r in rows}), 1):
        df = spark.createDataFrame([r for r in rows if r[0] == b], "batch int, id long, text string")
        for _ in range(1 + (turn == 3)):
            found = {tuple(r) for r in history.Accepted(spark, folder).add(df, "id", "batch", "text", number=turn).collect()}
        got |= found
    assert got == _near(rows)


def test_a_folder_keeps_its_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "one two three four five")], "batch int, id long, text string")
    history.Accepted(spark, f"file://{tmp_path}/a").add(df, "id", "batch", "text")
    again = df.selectExpr("2 AS batch", "id + 1 AS id", "text")
    assert [tuple(r) for r in history.Accepted(spark, f"file://{tmp_path}/a").add(again, "id", "batch", "text").collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        history.Accepted(spark, f"file://{tmp_path}/a", s=0.8).add(df, "id", "batch", "text")


def test_partners_share_segments():
    """Whatever a partner lacks, SHARED segments stay, or all that must be shared."""
    for s in (0.6, 0.7, 0.8, 0.9):
        n = np.arange(1, 400)
        lacks = n - np.ceil(s * n - 1e-9)
        assert (history.segment_count(n, s) - lacks >= np.minimum(history.SHARED, n - lacks)).all()


def test_settling_in_rounds_gives_the_same(spark, tmp_path):
    from docweave.session import Scratch

    rnd = random.Random(2)
    pairs = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(120)}
    links = spark.createDataFrame([(a, 1, b, 1) for a, b in pairs], "a long, batch_a long, b long, batch_b long")
    scratch = Scratch(spark, "t")
    one, many = ({r[0] for r in history.settle(links, scratch, str(k), k).collect()} for k in (1000, 0))
    assert one == many and one


def test_near_repeats_of_an_empty_table(spark):
    df = spark.createDataFrame([], "batch int, id long, text string")
    assert history.near_repeats(df, "id", "batch", "text").count() == 0


def test_same_hash(spark):
    h = "ab" * 16
    rows = [(1, 5, "A", h), (1, 3, "b", h.upper()), (2, 1, " a", "sha256:" + h + "ff"), (2, 2, "b", "SHA256:" + h), (2, 9, "a", h), (3, 8, None, h), (1, 10, "x", None), (1, 11, "y", " "), (3, 8, None, h)]
    df = spark.createDataFrame(rows, "batch int, id long, doc string, hash string")
    # order: 3 (b), 5 (a) in batch 1: b owns the hash
    assert {tuple(r) for r in history.same_hash(df, "id", "batch", "doc", "hash").collect()} == {(3, 5), (3, 1), (2, 8), (2, 9)}
    assert history.same_hash(df.limit(0), "id", "batch", "doc", "hash").count() == 0


# ---- nearest vectors


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 64))
    near = base[:150] + 0.2 * rng.normal(size=(150, 64))
    x = np.concatenate([base, near, np.repeat(base[:1], 15, axis=0)]).astype(np.float32)
    rows = [(f"c{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [("z1", None), ("z2", [0.0] * 64), ("z3", [1.0] * 32), ("z4", [float("nan")] * 64), ("z5", []), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows + bad + rows[:3], "id string, v array<float>").selectExpr("*", "1 AS key", "'q' AS vector")
    index = vectors.MultiprobeIndex(df, "id", "v")
    got = {(r["key_a"], r["key_b"]) for r in vectors.mutual(index.nearest(0.9)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    top = {}
    for i in range(len(u)):
        order = sorted(range(len(u)), key=lambda j: (-round(s[i, j], 9), j))[:10]
        top[i] = {j for j in order if s[i, j] >= 0.9}
    true = {(rows[i][0], rows[j][0]) for i in top for j in top[i] if i < j and i in top[j]}
    assert len(true & got) >= 0.97 * len(true) and not got - true
    assert vectors.MultiprobeIndex(df.limit(0), "id", "v").nearest(0.9).count() == 0


def test_every_equal_vector_has_its_list(spark):
    rows = [(f"k{i:02d}", [1.0] + [0.0] * 63) for i in range(20)] + [("z", [2.0, 0.1] + [0.0] * 62), ("far", [0.0, 1.0] + [0.0] * 62)]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    lists = {}
    for r in vectors.MultiprobeIndex(df, "id", "v").nearest(0.9).orderBy("key", "rank").collect():
        lists.setdefault(r["key"], []).append(r["neighbour"])
    names = [f"k{i:02d}" for i in range(20)]
    assert all(lists[n] == [x for x in names if x != n][:10] for n in names) and lists["z"] == names[:10] and "far" not in lists


def _shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {(f := files.apply(i)).getName(): f.length() for i in range(files.size())}


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_rounds_find_the_same_and_free_their_disk(spark, monkeypatch, no_broadcast):
    """In rounds of half a table the same pairs are met, and what they shuffled is gone."""
    base = np.random.default_rng(8).normal(size=(1500, 64))
    x = np.concatenate([base, base[:300] + 0.2 * np.random.default_rng(9).normal(size=(300, 64))])
    twice = [("c0000", [9.0] * 64), ("c0001", [float(v) for v in x[1]])]  # a key has its smallest vector
    df = spark.createDataFrame([(f"c{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)] + twice, "id string, v array<float>").repartition(2).cache()
    df.count()
    at_once = {tuple(r) for r in vectors.MultiprobeIndex(df, "id", "v").candidates().collect()}
    monkeypatch.setattr(vectors, "ROUND", 1, raising=False)
    before = _shuffled(spark)
    index = vectors.MultiprobeIndex(df, "id", "v")
    pairs = index.candidates()
    assert {tuple(r) for r in pairs.collect()} == at_once and len(at_once) >= 290
    left = lambda: sum(n for f, n in _shuffled(spark).items() if f not in before)
    for _ in range(20):  # files are removed in the background
        if left() < 400_000:
            break
        time.sleep(0.5)
    assert left() < 400_000  # the visits of one table alone are 37 800 rows of over 20 bytes
    assert index.vectors.where("heads[0] = 'c0000'").first()["vector"] == pytest.approx(min(list(x[0].astype(np.float32)), [9.0] * 64))


def test_tables_follow_from_the_recall():
    small, large = (vectors.tables_for(vectors.hashes_for(n), vectors.PROBES, 0.9) for n in (10_000, 10_000_000))
    assert 1 <= small < large


def test_probes_come_in_order_of_expected_success():
    moves = vectors.probe_order(8, 12)
    assert moves[0] == [0] and len(moves) == 12 and len({tuple(m) for m in moves}) == 12
    assert all(15 - a not in m for m in moves for a in m)


# ---- splitting


@pytest.mark.parametrize("size,overlap", [(16, 2), (32, 8), (5, 50), (1, 0)])
def test_pieces_give_back_the_text(size, overlap):
    rnd = random.Random(size)
    texts = ["", "   \n\n ", "x" * 1000, "word " * 400, "A b. C d.\n\nE f! " * 60, "é​\r\n" * 200, "".join(rnd.choice("ab .\n") for _ in range(2000))]
    for t in texts:
        pieces = splitting.split_text(t, size, overlap)
        assert "".join(t[p["core"] : p["stop"]] for p in pieces) == t
        assert all(p["content"] == t[p["start"] : p["stop"]] and len(p["content"]) // 4 <= size for p in pieces)
        limit = (size + 1) * 4 - 1
        shared = min(overlap * 4, limit // 2)
        assert all(p["core"] - p["start"] >= min(shared, p["core"]) for p in pieces[1:])
        word = lambda x, p: p["start"] == 0 or x[p["start"] - 1].isspace() or p["core"] - p["start"] == min(shared, p["core"])
        assert all(word(t, p) for p in pieces)
    assert splitting.split_text(None, 4, 1) is None


def test_cuts_lie_on_the_strongest_boundaries():
    t = "One two three. Four five six.\n\nSeven eight nine. Ten eleven."
    pieces = splitting.split_text(t, 9, 0)
    assert [p["content"] for p in pieces] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven."]


def test_split_rows(spark):
    config = spark.createDataFrame([("sentence", 4, 1), ("fixed", 2, 0)], "strategy string, chunk_size int, overlap int")
    rows = spark.createDataFrame([(1, "abcd " * 9, '{"strategy": "fixed"}'), (2, "abcd " * 4, "{broken"), (3, None, None), (4, "", "{}"), (5, "a" * 19, '{"strategy": "x"}'), (6, "a" * 20, None), (6, "a" * 20, None)], "id long, text string, metadata string")
    out = splitting.split_rows(splitting.with_limits(rows, config), "id", "text")
    assert {r["id"] for r in out.collect()} == {1, 2 if False else 1, 6} | ({2} if len("abcd " * 4) // 4 > 4 else set())
    assert out.where("id = 6 AND piece = 0").count() == 1


# ---- one form for look-alikes


@pytest.mark.parametrize(
    "a,b",
    [("Ｆｕｌｌ　ｗｉｄｔｈ １", "Full width 1"), ("café", "café"), ("a​b­c", "abc"), ("no break", " no  break "), ("Саfé", "Café"), ("ﬁn", "fin"), ("UQ‐6440", "UQ-6440"), ("οne", "one"), ("x\r\ny", "x y")],
)
def test_look_alikes_have_one_form(a, b):
    assert unify.unify(a) == unify.unify(b)


@pytest.mark.parametrize("a,b", [("resume", "résumé"), ("ab", "a b"), ("One", "one"), ("a.", "a!"), ("x²", "x2"), ("10", "1O"), ("a,b", "a;b")])
def test_visible_differences_stay(a, b):
    assert unify.unify(a) != unify.unify(b)
    assert unify.unify("STRASSE", casefold=True) == unify.unify("straße", casefold=True)


def test_form_is_stable_and_pairs_are_found(spark):
    texts = ["Abc", "Ａbc", "Аbc", "abc", None, "", " ​", "Abc ", "Abc"]
    for t in texts:
        assert t is None or unify.unify(unify.unify(t)) == unify.unify(t)
    df = spark.createDataFrame(list(enumerate(texts)) + [(1, "Ａbc")], "id long, t string").selectExpr("*", "'c' AS form", "1 AS k")
    got = {tuple(r) for r in unify.look_alike_pairs(df, "id", "t", rows_per_part=2).collect()}
    same = {0: "Abc", 1: "Ａbc", 2: "Аbc", 7: "Abc ", 8: "Abc"}
    assert got == {(a, b) for a in same for b in same if a < b and same[a] != same[b]}
    assert unify.look_alike_pairs(df.limit(0), "id", "t").count() == 0
    assert [tuple(r) for r in unify.look_alike_classes(df, "id", "t").collect()] == [("Abc", 5, 4, 0)]


# ---- scanned pages

PAGE = "Handling drawings in the archive    {n}\nThe quarterly report was docu-\nmented and the long-\nrunning index was {w}.\nMore text follows here.\nPage {n} of 9\n"


def test_noise_of_scanned_pages(spark):
    filler = [(100 + i, "The report was documented. A long-running index was listed. More batch work follows here in the quarterly archive.") for i in range(30)]
    noisy = "".join(PAGE.format(n=n, w="listed") for n in (3, 4, 5))
    rows = filler + [
        (1, noisy),
        (2, "The batcli was listed here.\nMore text follows.\n"),
        (3, "The long-\nrunning index was listed.\nMore text."),
        (4, "viii\nThe report was documented.\nix\nMore."),
        (5, None),
        (6, ""),
        (7, "One line only, no pages, batcli"),
        (8, "- restore the index\n- restore the index\nThe report was documented."),
        (1, noisy),
    ]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 AS key", "'x' AS word")
    noise = scans.ScanNoise(df, "id", "text")
    got = {tuple(r) for r in noise.found().collect()}
    assert got == {(1, "hyphenation"), (1, "header"), (1, "page_number"), (2, "misread"), (4, "page_number")}
    fixed = {r["id"]: r["text"] for r in noise.repaired().collect()}
    assert "documented" in fixed[1] and "long-running" in fixed[1] and "Page" not in fixed[1] and "Handling" not in fixed[1]
    assert fixed[2].startswith("The batch was") and fixed[5] is None and fixed[6] == "" and "batcli" in fixed[7]
    assert len(fixed) == 38


@pytest.mark.parametrize("line,is_number", [("12", True), ("- 12 -", True), ("[7]", True), ("Seite 15", True), ("p. 3", True), ("93 / 104", True), ("viii", True), ("— 9 —", True), ("12 apples", False), ("", False), ("1) first", False), ("...", False), ("civil", False), ("minutes.", False)])
def test_page_number_lines(line, is_number):
    assert scans.is_page_number(line) == is_number


def test_pages_that_form_feeds_part():
    footer = "\f".join(["One text begins", "Another follows it", "Nothing is left", "Here we stop"][n] + "\non and on.\n" + ("Quarterly archive report" if n != 2 else "the end of it") for n in range(4))
    assert len(scans.Page(footer).headers) == 3
    title = "The storage handbook\nand it goes on in lower case\nmore here\f" * 2
    p = scans.Page(title[:-1])
    assert {p.lines[k] for k in p.headers} >= {"The storage handbook"}


@pytest.mark.parametrize("text,found", [("a\n1998\nb", 0), ("x\nI\ny", 0), ("a\n12\nb\n13\nc", 2), ("a\n1998\nb\n2004", 0), ("a\n12\fb\nc\f d\n14", 2), ("Seite 3\na\nSeite 4", 2), ("vi\na\nxii", 2), ("1998\na\n1999\nb\n" + "x" * 50, 2)])
def test_page_numbers_come_in_sequences(text, found):
    assert len(scans.Page(text).numbers) == found


def test_scans_of_an_empty_table(spark):
    assert scans.ScanNoise(spark.createDataFrame([], "id long, text string"), "id", "text").found().count() == 0


# ---- tokens


def test_merge_replay_is_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    path = f"{tokenize.FOLDER}/byte_bpe_50k.json"
    public = Tokenizer.from_file(path)
    public.encode_special_tokens = True
    rnd = random.Random(0)
    texts = ["", None, "aaaa aaa", "<|endoftext|> x", "naïve — ça 😀😀\r\n\r\n  y ", "日本語", "don't WE'LL I've", "x" * 20000, " " * 50, "\x00\x01", *("".join(rnd.choice("abcde éß1.\n ") for _ in range(300)) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("*", "1 AS word")
    got = {r["id"]: r["ids"] for r in tokenize.encode_corpus(df, "text").collect()}
    assert all(got[i] == public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts))
    assert tokenize.encode_corpus(df.limit(0), "text").count() == 0
    counts = tokenize.encode_corpus(df, "text", count="n").where("id = 7").first()["n"]
    assert counts == len(got[7])


# ---- mixing


def test_shares_and_repeats(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["big", "Big ", "small", None, "other"]) if i % 9 else "small", "some words here " * rnd.randrange(0, 9)) for i in range(900)] + [(1000, "tiny", "word " * 20), (1001, "tiny", None)]
    df = spark.createDataFrame(rows, "id long, source string, text string").selectExpr("*", "1 AS tokens", "2 AS turn")
    targets = spark.createDataFrame([("BIG", 0.6, 1), ("small", 0.3, 2), ("absent", 0.1, 3), (None, 0.5, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(df, targets, key="id")
    out = m.rows().toPandas()
    assert out["tokens"].sum() <= m.budget
    share = out.groupby("source")["tokens"].sum() / out["tokens"].sum()
    assert abs(share["big"] - 0.6 / 0.9) < 0.02 and abs(share["small"] - 0.3 / 0.9) < 0.02
    assert out[out.source == "big"]["copy"].max() == 1 and out["copy"].max() <= 2
    assert not out.duplicated(["id", "copy"]).any()
    assert set(m.shares().toPandas()["source"]) == {"big", "small", "absent"}
    again = mixing.Mixture(df, targets, key="id").rows().toPandas()
    assert set(map(tuple, again[["id", "copy"]].values)) == set(map(tuple, out[["id", "copy"]].values))
    everything = mixing.Mixture(df, targets, key="id", budget=10**9).rows().toPandas()
    assert everything.groupby("source")["copy"].max().to_dict() == {"big": 1, "small": 2}
    assert mixing.Mixture(df.limit(0), targets, key="id").rows().count() == 0


# ---- cut texts


@pytest.mark.parametrize(
    "text,verdict",
    [
        ("It was done.", "complete"),
        ("It was done. ✅", "complete"),
        ("It was done. Then we d�", "cut"),
        ("It was done. Then we went to…", "cut"),
        ("It was done, tables and so on…", "complete"),
        ("It was done. Then we went to [...]", "cut"),
        ("It was done. Then we wen  \n", "cut"),
        ("| a | b |\n| c | d |", "open"),
        ("| a | b |\n| c | d", "cut"),
        ("See it.\n\n/srv/notes/a/b.md", "open"),
        ("See it.\n\n/srv/notes/a/b", "cut"),
        ("See it.\n\n[1] Author, Title of it, 2013", "open"),
        ("See it.\n\n[1] Author, Title of", "cut"),
        ("Use it:\n\n    x = call(1, 'a')", "open"),
        ("Use it:\n\n    x = call(1, 'a", "cut"),
        ("", "complete"),
        ("  ​ ", "complete"),
    ],
)
def test_endings(text, verdict):
    assert truncation.ending(text)[0] == verdict


def test_truncation_by_words_and_limits(spark):
    rnd = random.Random(2)
    nouns = ["archive", "index", "report", "meeting", "schema", "record"]
    sentence = lambda: f"The {rnd.choice(nouns)} of the {rnd.choice(nouns)} was moved by {rnd.randrange(99)} to another {rnd.choice(nouns)}."
    rows, cut = [], set()
    for i in range(400):
        body = f"Minutes of the {rnd.choice(nouns)} meeting\n\n" + " ".join(sentence() for _ in range(rnd.randrange(2, 12)))
        limited = i % 2 == 0
        if limited and len(body) > 300:
            body = body[:300]
            if not body.rstrip().endswith("."):
                cut.add(i)
        rows.append((i, "Limited " if limited else "free", body))
    rows += [(900, "free", "Minutes of the archive meeting"), (901, "free", None), (902, None, ""), (903, "free", sentence()[:-9]), (904, "free", sentence()), (900, "free", "Minutes of the archive meeting")]
    cut.add(903)
    df = spark.createDataFrame(rows, "id long, source string, text string").selectExpr("*", "1 AS size", "'v' AS verdict")
    t = truncation.Truncation(df, key="id")
    assert {r["id"] for r in t.found().collect()} == cut
    assert [(r["source"], r["size"]) for r in t.limits.where("censored > 0.9").collect()] == [("limited", 300)]
    rates = {r["source"]: r for r in t.rates().collect()}
    assert rates["limited"]["at_limit"] == len(cut) - 1 and rates["free"]["cut"] == 1
    assert truncation.Truncation(df.limit(0), key="id").found().count() == 0
