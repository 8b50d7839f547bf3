import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from concordia.llm import html, importance, kmeans, packing

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, " . \n", "A b C", "hello wörld 12 x", "x" * 100 + " y " + "z" * 49 + " " + "q" * 48, "日本語 テスト. a-b_c", "The the THE " * 9000, "a b c d e f g h i j k l m n o p q r s t u v", "<|endoftext|>x I'm it's\x0b\x85y　z é ́ ΑΣ ΑΣΑ İ"]


def odd(spark):
    """Odd texts, repeated rows, null ids, and columns named like those that the operators make."""
    rows = [(i, t, i, "x", -1) for i, t in enumerate(ODD)] + [(3, "A b C", 0, None, None), (None, None, 0, None, None), (None, ODD[8], 0, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket int, id string, part int")


def vectors(spark):
    rng = np.random.default_rng(5)
    many = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 64)))]
    many += [(1000 + i, many[7][1]) for i in range(200)] + [(7, many[7][1]), (None, many[8][1]), (None, many[9][1])]
    many += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None] + [1.0] * 63), (2005, [float("nan")] * 64), (2006, [float("inf")] + [0.0] * 63), (2007, [0.0] * 64), (2008, [-0.0005] * 64)]
    return spark.createDataFrame([(i, v, 1, "x") for i, v in many], "vec_id long, embedding array<double>, cluster int, ids string")


def features(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return len(words), Counter(zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


def resampled(docs, target, percent=5):
    """(id, n_features, weight, score, rank) by plain loops; docs: (id, text)."""
    own, other = [(i, *features(t)) for i, t in docs], Counter()
    for t in target:
        other.update(features(t)[1])
    both = Counter()
    for _, _, f in own:
        both.update(f)
    all_s, all_t, scored = sum(both.values()), sum(other.values()), []
    for i, n, f in own:
        weight = sum(c * math.floor(1000 * math.log(((other[b] + 1) * (all_s + 10_000)) / ((both[b] + 1) * (all_t + 10_000)))) for b, c in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    rank = {id(x): r for r, x in enumerate(can[: percent * len(can) // 100], 1)}
    return sorted(((x[0], x[2], x[3], x[4], rank.get(id(x))) for x in scored), key=repr)


@pytest.mark.parametrize("rows_a_range", [50_000, 7])
def test_resampling_agrees_with_brute_force(spark, sf, rows_a_range):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    out = importance.resample(docs.repartition(3), target, rows_a_range=rows_a_range).select("doc_id", "n_features", "weight", "score", "rank")
    brute = resampled([tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.collect()])
    assert sorted(map(tuple, out.collect()), key=repr) == brute
    assert sum(x[4] is not None for x in brute) > 5


def test_resampling_of_odd_rows(spark):
    target = spark.createDataFrame([("hello wörld",), (None,), ("the the",)], "text string")
    out = importance.resample(odd(spark).repartition(2), target, percent=50).select("doc_id", "n_features", "weight", "score", "rank")
    docs = [tuple(r) for r in odd(spark).select("doc_id", "text").collect()]
    assert sorted(map(tuple, out.collect()), key=repr) == resampled(docs, ["hello wörld", None, "the the"], 50)
    assert importance.resample(odd(spark).limit(0), target).count() == 0
    assert sorted(map(tuple, importance.resample(odd(spark), target.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == resampled(docs, [])


@pytest.mark.parametrize("size", [importance.CHUNK_BYTES, 700])
def test_postings_hold_every_feature(monkeypatch, size):
    monkeypatch.setattr(importance, "CHUNK_BYTES", size)  # long texts, and words, cross blocks
    rng = np.random.default_rng(3)
    texts = [(t or "").encode() for t in ODD] + ["".join(rng.choice(list("abcdefgh  \n.,XYZé")) for _ in range(int(n))).encode() for n in rng.integers(1, 2000, 60)] + [b"y" * 5000 + b" end"]
    n_words, n_features, buckets, _, begin, whole = importance.chunk_postings(texts)
    found = [Counter() for _ in texts]
    for b, piece in zip(buckets, np.split(whole, begin[1:]), strict=True):
        for d, c in zip(*importance.unpacked(piece), strict=True):
            found[d][int(b)] += int(c)
    for i, t in enumerate(texts):
        n, f = features(t.decode())
        assert (n_words[i], n_features[i], +found[i]) == (n, sum(f.values()), f)


def clustered(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    points = np.array([v for _, v in kept], dtype=object)
    first = sorted(kept, key=lambda x: (hashlib.sha256(f"3:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))[:k]
    centroids = [list(v) for _, v in first]

    def nearest():
        d = np.stack([((points - np.array(c, dtype=object)) ** 2).sum(1) for c in centroids], axis=1)
        return [(min(range(len(centroids)), key=lambda j: (row[j], j)), min(row)) for row in d]

    for _ in range(rounds):
        own = [c for c, _ in nearest()]
        for c in set(own):
            mine = points[[i for i, x in enumerate(own) if x == c]]
            centroids[c] = [s // len(mine) for s in mine.sum(0)]
    found = nearest()
    each = Counter()
    for c, d in found:
        each[c] += d
    return sorted(((i, c, d, each[c], sum(each.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, found, strict=True)), key=repr)


@pytest.mark.parametrize("block", [kmeans.BLOCK, 100])
def test_clusters_agree_with_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(kmeans, "BLOCK", block)
    df = vectors(spark)
    out = kmeans.cluster(df.repartition(3))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == clustered([tuple(r) for r in df.select("vec_id", "embedding").collect()])
    few = df.where("vec_id in (1, 2, 3)")
    assert sorted(map(tuple, kmeans.cluster(few).collect()), key=repr) == clustered([tuple(r) for r in few.select("vec_id", "embedding").collect()])
    assert kmeans.cluster(df.limit(0)).count() == 0


def test_trees_prune_and_assign_whole_nodes():
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (8, 64))
    points = np.concatenate([m + rng.integers(-100, 100, (500, 64)) for m in middles])
    order, nodes = kmeans.tree_of(points)
    found = list(kmeans.filtered(points[order], nodes, middles))
    whole = sum(e - s for s, e, _, node in found if node is not None)
    assert whole > 0.9 * len(points)
    assert (kmeans.assigned(points[order], nodes, middles) == kmeans.distances(points[order], middles).argmin(1)).all()
    counts, sums = kmeans.gathered(points[order], nodes, middles)
    assert counts.sum() == len(points) and (sums.sum(0) == points.sum(0)).all()
    # distances beyond what doubles hold exactly
    far = np.array([[(1 << 27) - 1] * 64, [-(1 << 27) + 1] * 64])
    assert kmeans.distances(far, far[:1])[:, 0].tolist() == [0, 64 * (2 * ((1 << 27) - 1)) ** 2]


@pytest.fixture(scope="module")
def vocab():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@functools.cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(path, text):
    return [*library(path).encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(spark, docs, path, size):
    texts = Counter((r["doc_id"], tuple(library_ids(path, r["text"]))) for r in docs.select("doc_id", "text").collect())
    rows = [r.asDict() for r in packing.pack(docs, path, size=size).collect()]
    by_place = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in by_place:  # gapless, whole sequences
        assert (r["sequence_id"], r["offset"]) == (at // size, at % size) and r["offset"] + r["length"] <= size and r["length"] > 0
        at += r["length"]
    assert at == sum(len(ids) * n for (_, ids), n in texts.items())
    # a document's pieces follow one another: put together, they are its ids
    found, stream = Counter(), []
    for r in by_place:
        if r["start"] == 0:
            stream.append([])
        assert sum(x["length"] for x in stream[-1]) == r["start"]
        stream[-1].append(r)
    for pieces in stream:
        key = next(k for k in texts if k[0] == pieces[0]["doc_id"] and len(k[1]) == pieces[0]["doc_tokens"] and all(zlib.crc32(np.array(k[1][p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for p in pieces))
        assert sum(p["length"] for p in pieces) == pieces[0]["doc_tokens"]
        found[key] += 1
    assert found == texts
    whole = sorted(packing.sequences(docs, path, size=size, pad_id=9).collect())
    assert [r["sequence_id"] for r in whole] == list(range(-(-at // size))) and sum(r["n"] for r in whole) == at
    last = len(whole[-1]["ids"])
    assert all(len(r["ids"]) == size for r in whole[:-1]) and last & (last - 1) == 0 and whole[-1]["ids"][whole[-1]["n"] :] == [9] * (last - whole[-1]["n"])


def test_packing_of_odd_rows(spark, vocab):
    check_packing(spark, odd(spark).repartition(3), vocab, 64)
    check_packing(spark, odd(spark).where("doc_id < 1").coalesce(1), vocab, 2048)
    assert packing.pack(odd(spark).limit(0), vocab).count() == 0 and packing.sequences(odd(spark).limit(0), vocab).count() == 0


def test_packing_of_documents(spark, sf, vocab):
    check_packing(spark, spark.read.parquet(f"{sf}/documents.parquet").repartition(5), vocab, 2048)


def test_long_texts_are_read_in_stretches(vocab, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 50)
    text = "Some words, éÀ and " + "x" * 120 + " more of them\n\n" + "thé end. " * 40
    own = packing.WordIds(vocab)
    assert np.frombuffer(own.long(text), own.kind).tolist() == library_ids(vocab, text)[:-1]


def test_words_by_themselves_are_encoded_as_in_their_text(vocab, sf):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocab), packing.WordIds(vocab)
    rng = np.random.default_rng(2)
    letters = list("aAbȩ́́ͅ \n\t\r\x0b\x0c\x1c\x85\xa0 　'sΣΑςİſ1２½-_.<|>日本각👍🏽‍") + ["<|endoftext|>", "'ll", " the ", "ing"]
    import pyarrow.parquet as pq

    for text in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist():
        assert np.frombuffer(own([text or ""])[0], own.kind).tolist() == lib.encode(text or "", add_special_tokens=False).ids
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(int(rng.integers(1, 30))))
        assert np.frombuffer(own([text])[0], own.kind).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_templates_of_hosts_with_the_same_tokens(spark):
    """Two hosts in one task whose pages have the same menu in opposite order."""
    menu = ["<li>Home page</li>", "<li>All products</li>", "<li>Our company</li>", "<li>Get in touch</li>"]

    def page(host, i):
        items = "".join(menu if host == "a" else menu[::-1])
        return f"<html><body><div><ul>{items}</ul></div><div><h1>Story {host}{i}</h1><p>Some words {host} {i} of its own, told at length and {i * 7} times.</p></div></body></html>"

    rows = [(f"{h}{i}", f"http://{h}.example/{i}", page(h, i)) for i in range(6) for h in "ab"]
    want = {(f"{h}{i}", f"Story {h}{i}\n\nSome words {h} {i} of its own, told at length and {i * 7} times.") for i in range(6) for h in "ab"}
    for n in (1, 4):
        df = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1).repartition(n)
        assert {(r["page_id"], r["text"]) for r in html.extract(df).collect()} == want


def test_scores_do_not_follow_the_partitioning(spark, sf):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    runs = [sorted(map(tuple, importance.resample(docs.repartition(n), target).collect())) for n in (1, 6)]
    assert runs[0] == runs[1]


def test_articles_known_by_construction(spark):
    """Pages of three hosts, put together from parts: what extract() gives is the article's parts, whatever the host's frame, and however the pages are dealt."""
    import random

    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    frames = {
        "tags": ('<header><a href="/">Name of the site</a></header><nav><ul>{menu}</ul></nav><main><article><h1>{title}</h1>{body}</article></main><aside><p>{aside}</p></aside><footer>All rights</footer>'),
        "plain": ('<div><div><span>Name of the site</span></div><div>{menu}</div><div><h1>{title}</h1>{body}</div><div class="sidebar"><p>{aside}</p></div><div class="footer">All rights</div></div>'),
        "nested": ('<div><table><tr><td>{menu}</td><td><div><div><h1>{title}</h1>{body}</div></div></td></tr></table><form><input name="q"> Search here</form><div class="comments"><p>{aside}</p></div></div>'),
    }
    rows, want = [], {}
    for host, frame in frames.items():
        menu = "".join(f'<li><a href="/{i}">{sentence(2)}</a></li>' for i in range(5))
        for i in range(12):
            title, blocks = sentence(4), [sentence(rnd.randint(8, 40)) for _ in range(rnd.randint(2, 6))]
            shown = [b.replace(" ", " <b>bold</b> ", 1) if j == 1 else b for j, b in enumerate(blocks)]
            body = "".join(f"<p>{b} &amp; more</p>" if j != 2 else f"<ul><li>{b} &amp; more</li></ul><script>var x = '{sentence(3)}'</script>" for j, b in enumerate(shown))
            html_text = "<html><head><title>t</title><style>p {}</style></head><body>" + frame.format(menu=menu, title=title, body=body, aside=sentence(rnd.randint(4, 9))) + "</body></html>"
            key = f"{host}{i}"
            rows.append((key, f"https://{host}.example/{i}", html_text))
            texts = [b.replace("<b>", "").replace("</b>", "") for b in shown]
            want[key] = "\n\n".join([title, *(f"{t} & more" for t in texts)])
    for n in (1, 5):
        out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(n)).collect()}
        assert out == want
