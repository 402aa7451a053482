"""Clusters, page extraction and the prefix trie against plain Python, and their edge cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np

from raglens.llm import prefix_trie, subvector_clusters


# --- subvector clusters ---------------------------------------------------------


def plain_clusters(rows, k, rounds, size):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    centroids = [v.copy() for _, v in first]
    near = lambda v: min(range(len(centroids)), key=lambda j: (int(((v - centroids[j]) ** 2).sum()), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if members:
                centroids[j] = np.array([int(s) // len(members) for s in sum(members)])
    out = [(i, near(v), int(((v - centroids[near(v)]) ** 2).sum()), hashlib.sha256(",".join(map(str, centroids[near(v)].tolist())).encode()).hexdigest()) for i, v in kept]
    total = defaultdict(int)
    for _, c, d, _ in out:
        total[c] += d
    return sorted(((i, c, d, total[c], sum(total.values()), s) for i, c, d, s in out), key=str)


def test_clusters_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.4, 6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [0.25] * 6) for i in range(300, 420)]  # one common vector: ties everywhere
    rows += [(7, rows[0][1]), (None, rows[1][1]), (500, None), (501, []), (502, [0.1] * 5), (503, [0.1] * 5 + [None]), (504, [float("nan")] * 6), (505, [float("inf")] + [0.0] * 5)]
    for chunk in (64, 1 << 15):
        subvector_clusters.CHUNK, held = chunk, subvector_clusters.CHUNK
        try:
            made = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as cluster", "'x' as id")
            found = subvector_clusters.cluster_vectors(made.repartition(5), size=6)
            assert sorted((tuple(r) for r in found.collect()), key=str) == plain_clusters(rows, 16, 3, 6)
        finally:
            subvector_clusters.CHUNK = held


def test_clusters_of_few_none_and_huge(spark):
    kind = "vec_id long, embedding array<double>"
    assert subvector_clusters.cluster_vectors(spark.createDataFrame([], kind)).collect() == []
    few = subvector_clusters.cluster_vectors(spark.createDataFrame([(1, [0.5] * 4), (2, [0.5] * 4), (3, [1e30] * 4)], kind), size=4)
    got = {r["vec_id"]: r for r in few.collect()}
    assert got[1]["distance"] == got[2]["distance"] == got[1]["inertia"] == 0 and got[3]["cluster"] is None


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(0)
    for low, high in ((-3, 4), (-(1 << 27), 1 << 27)):
        vectors = rng.integers(low, high, (500, 7))
        made = subvector_clusters.Encoded.of(vectors, 3)
        assert (made.vectors() == vectors).all()
        centroids = rng.integers(low, high, (4, 7))
        assert (made.distances(centroids) == ((vectors[:, None] - centroids[None]) ** 2).sum(2)).all()


# --- prefix trie ----------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, cs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in under) for p in under)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(str(c) for c in cs if len(rebuilt[c]) == len(path))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_equals_plain_one(spark):
    rows = []
    for c in [*range(98, 130), 200, 201, 202, 305]:
        for t in range(c % 7 + (20 if c in (100, 117) else 0)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {t if t < 3 else (c // 3, t)}"))
    rows += [(c, t, None, None) for c in (400, 401) for t in range(3)]  # nulls, and equal ones
    rows += [(150, None, "system", "first"), (150, 5, "user", "b"), (150, 5, "user", "a"), (150, 5, "user", "a"), (None, 1, "user", "nobody's")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as x", "'n' as node")
    for width in (2, 8):
        found = prefix_trie.trie(made.repartition(6), width)
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain_trie(rows), width


def test_trie_of_nothing_and_ranges(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, t, "user", f"t{t}") for t in range(40)] + [(2, t, "user", f"t{t}") for t in range(40)]
    held, prefix_trie.RANGE = prefix_trie.RANGE, 3
    try:
        found = prefix_trie.trie(spark.createDataFrame(rows, kind), 2)
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain_trie(rows)
    finally:
        prefix_trie.RANGE = held


# --- main text of pages ----------------------------------------------------------


def test_leaf_blocks():
    from raglens.llm.html_blocks import leaf_blocks

    html = "<p>one<p>t<b>w</b>o &amp;&nbsp;<i>x</i><br>y<ul><li><a href='/'>three</a><li>fo<!-- <p> -->ur</ul><script>var t='</p>';</script><style>p{}</style><div title='a>b'>five</div>six<div"
    found = leaf_blocks(html, tags=True)
    assert [x.text for x in found] == ["one", "two & x y", "three", "four", "five", "six"]
    assert found[2].linked == 1.0 and found[0].linked == 0.0
    assert "ul" in found[3].tags and "p" not in found[3].tags and found[5].tags == ()
    assert leaf_blocks("") == [] and leaf_blocks("<script>never ended <p>x") == [] and leaf_blocks("a < b & c")[0].text == "a < b & c"
    deep = "<div class=a>" * 20000 + "x" + "<p>y"
    assert [x.text for x in leaf_blocks(deep)] == ["x", "y"]


def test_labeller_gradients():
    from raglens.llm import page_text
    from raglens.llm.html_blocks import leaf_blocks

    pages = [leaf_blocks("<nav><a>x y</a></nav><p>a, b c.</p><p>d</p>"), leaf_blocks("<h1>q</h1>")]
    blocks, y = page_text.Blocks.of(pages), np.array([0, 1, 1, 0], np.float32)
    model, rng = page_text.Labeller.fresh(1), np.random.default_rng(0)
    grads, _ = model.gradients(blocks, y, np.arange(2))
    for name, g in grads.items():
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), tuple(int(rng.integers(n)) for n in g.shape)]:
            old, losses = model.p[name][at], []
            for d in (1e-2, -1e-2):
                model.p[name][at] = old + d
                losses.append(model.gradients(blocks, y, np.arange(2))[1])
            model.p[name][at] = old
            assert abs((losses[0] - losses[1]) / 2e-2 - g[at]) < 3e-3, name
    apart = [model.scores(page_text.Blocks.of([p])) for p in pages]
    assert np.allclose(np.concatenate(apart), model.scores(blocks), atol=1e-5)


def test_main_text_of_other_layouts(spark):
    from raglens.llm import page_text

    say = "The river rose in the night, and by morning the lower road was under water. Nobody had expected it."
    body = f"<h1>River over its banks</h1><p>{say}</p><p>{say[::-1]}</p><ul><li>one thing, said.</li></ul>"
    text = f"River over its banks\n{say}\n{say[::-1]}\none thing, said."
    around = '<header><a href="/">My site</a></header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>{}<aside><h3>Related</h3><p>Read this too, it is long and it is good.</p></aside><div class="cookie-notice"><p>We use cookies, as all do.</p></div><section class="comments"><h3>Comments</h3><div class="comment"><p>I was there, and it was wet.</p></div></section><form><label>Mail</label><button>Go</button></form><footer>&copy; 2020 All rights.</footer>'
    learnt = [(i, f"<nav><a>a {i}</a></nav><article><h1>{say[:20]}</h1><p>{say} {i}</p><p>{i} is here, they said.</p></article><footer>Contact us {i}</footer>") for i in range(40)]
    tried = [around.format(f"<article>{body}</article>"), around.format(f"<main>{body}</main>"), around.format(f'<div class="post-content">{body}</div>'), None, "", "<nav>only</nav>", around.format(f"<article>{body}</article>")]
    made = spark.createDataFrame([(i, None, h, "x") for i, h in learnt] + [(100 + i, "u", h, "y") for i, h in enumerate(tried)], "page_id long, url string, html string, text string").repartition(3)
    got = {r["page_id"]: r for r in page_text.main_text(made, page_text.train(made)).collect()}
    assert len(got) == 47 and got[3]["text"] == f"{say[:20]}\n{say} 3\n3 is here, they said."
    for i in (100, 101, 102, 106):
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text), i
    assert [got[i]["text"] for i in (103, 104, 105)] == ["", "", ""]
    assert page_text.main_text(made.limit(0), page_text.Labeller.fresh(1)).collect() == []
