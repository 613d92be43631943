"""The training-data operators on small documents, against brute force or an exact round trip."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import decontaminate, html_text, language, line_dedup, minhash, packing, substrings, token_file, tokens, topk, toxicity
from storyloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefgh"), 6)) for _ in range(400)]


def prose(n, seed=0):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCS)


LONG = prose(3000, 1)
MIXED = [(5, "hello world"), (3, None), (4, ""), (1, LONG), (2, LONG), (7, "hello world"), (None, "no id"), (9, " \n\t "), (10, "a\n\n b  c d"), (11, "x<|endoftext|>y")]


# Tokens, token files, packing


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    e = tokens.Encoder(tokens.vocabulary_path(name), most=50)
    texts = [t or "" for _, t in MIXED] + ["a\n \nb", "a  \nb", "it's 'S we'll 22 333x", "\x1c a \x1f b", "ΑΣ Σ é", "a\0b"]
    for _ in range(2):
        ids, sizes = e.encode(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert own.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ids", [[], [7], [0] * 9000, list(range(5000)), [2**32 - 1, 0, 3], RNG.zipf(1.3, 20000) % 50000])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    payload, starts = token_file.pack_blocks(ids, block=512)
    assert (token_file.read_blocks(payload, starts.tolist()) == ids).all()
    if len(starts):
        assert (token_file.read_block(payload, int(starts[-1])) == ids[512 * (len(starts) - 1) :]).all()


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "files")
    token_file.write_token_files(docs_of(spark, MIXED), path)
    found = token_file.read_token_files(spark, path).collect()
    tokenizer, start = tokens.encoder("byte_bpe_50k.json").tokenizer, 0
    expected = []
    for doc_id, text in sorted(MIXED, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_token_files_of_nothing(spark, tmp_path):
    token_file.write_token_files(docs_of(spark, []), str(tmp_path / "none"))
    assert token_file.read_token_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(rng.integers(1, 30)) for n in rng.integers(1, 101, 40)}
    bins: dict[int, list[tuple[int, int]]] = {}
    placed = dict.fromkeys(counts, 0)
    for length, rank, count, first, offset in packing.plan(counts, 100):
        placed[length] += count
        for k in range(count):
            bins.setdefault(first + k, []).append((offset, length))
    assert placed == counts
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 100 and sum(3 * n > 100 for _, n in items) <= 2
    total = sum(n * c for n, c in counts.items())
    assert len(bins) <= max(-(-total // 100), sum(c for n, c in counts.items() if n > 50)) * 1.15 + 2


def test_packing_places_every_piece(spark):
    rows = packing.pack_documents(docs_of(spark, MIXED), capacity=64).collect()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in pieces.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    tokenizer = tokens.encoder("word_bpe_49k.json").tokenizer
    for doc_id, text in MIXED:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        assert sum(r["length"] for r in rows if r["doc_id"] == doc_id) == n
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


# Search


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(120, None), (121, [1.0, None]), (122, [float("nan")] * 8), (123, [1.0, 2.0]), (124, []), (100, rows[100][1]), (None, rows[0][1]), (125, rows[3][1])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, block=32, query_block=2).collect()
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        w = next(v for i, v in good if i == q)
        scores = sorted(((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in good if i != q))[:5]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, found)) == expected


def test_top_k_of_a_query_that_is_repeated():
    scores = np.array([[9, 50, 50, 50, 50, 8, 7, 6]], np.int64)
    found = topk.best_of(scores, np.array([2]), np.array([1, 2, 2, 2, 2, 3, 4, 5]), 3)
    assert found.values.tolist() == [[2, 1, 9], [2, 3, 8], [2, 4, 7]]


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 2).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (2, -(2**63))]


# Lines


LINES = [(1, "A line of twenty characters\nx"), (2, "  a LINE of twenty characters\t\ny\ny"), (3, "a line of twenty characters"), (4, None), (5, ""), (None, "a line of twenty characters\nz"), (6, "short\nshort"), (7, "short"), (8, "short\n")]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_line_dedup(spark, broadcast_bytes):
    out = line_dedup.dedup_lines(docs_of(spark, LINES), broadcast_bytes=broadcast_bytes, rest=["lang"]).collect()
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out}
    assert found == {1: ("x", 2, 1), 2: ("y\ny", 3, 1), 3: ("a line of twenty characters", 1, 0), 4: ("", 1, 0), 5: ("", 1, 0), None: ("z", 2, 1), 6: ("short\nshort", 2, 0), 7: ("short", 1, 0), 8: ("short\n", 2, 0)}
    assert all(r["rest"]["lang"] == "en" and r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in out)
    assert line_dedup.dedup_lines(docs_of(spark, []), broadcast_bytes=broadcast_bytes).count() == 0


@pytest.mark.parametrize("n", [1, 5, 3000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    seeds, slots = line_dedup.build_hash(keys)
    shard = line_dedup.Shard({"n": len(keys), "seeds": seeds.tobytes(), "slots": slots.tobytes(), "prints": b"", "counts": b"", "last_docs": b""})
    assert sorted(shard.places(keys).tolist()) == list(range(len(keys)))


# Near-duplicates


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    return {rows[i][0]: (len(sets[i]), min(rows[j][0] for j in range(len(rows)) if root(j) == root(i))) for i in range(len(rows))}


def edited(text, n, seed):
    rng, words = np.random.default_rng(seed), text.split()
    for k in rng.integers(0, len(words), n):
        words[k] = f"edit{seed}x{k}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    base, chain = prose(150, 3), prose(120, 4)
    rows = [(k, edited(base, k % 9, k)) for k in range(60)]
    rows += [(100 + k, " ".join(chain.split()[k * 4 :] + prose(4 * k, 50 + k).split())) for k in range(12)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one two"), (204, "One  two"), (205, "one two three"), (300, base), (301, base.upper())]
    rows += [(400 + k, prose(60, 90 + k)) for k in range(20)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows), width=4).collect()}
    assert found == brute_components(rows, 4, 80)


def test_near_duplicates_of_odd_rows(spark):
    text = prose(30, 8)
    rows = minhash.near_duplicates(docs_of(spark, [(2, text), (2, text), (None, text), (None, "other words here and there"), (1, text)])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("1", "1", True), ("2", "1", False), ("2", "1", False), ("None", "1", False), ("None", "None", True)]
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0
    kept = minhash.without_near_duplicates(docs_of(spark, [(2, text), (2, text), (None, text), (1, text), (7, "a b c d e f"), (8, None)]))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and sorted(r["doc_id"] for r in kept.collect()) == [1, 7, 8]


def test_links_between_blocks_are_exact():
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 1, 2, 30, 31)]
    names = [bytes([k]) for k in range(5)]
    joined = minhash.links_between(names, names, sets, np.zeros(5, int), 80)
    assert len(joined) == 3 and {frozenset(x) for x in joined} <= {frozenset((names[a], names[b])) for a, b in ((0, 1), (0, 2), (1, 2), (3, 4))}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(20)] + [(b"z", b"y"), (b"q", b"q")], "a binary, b binary")
    labels = {bytes(r["node"]): bytes(r["label"]) for r in connected_components(edges).collect()}
    assert len({labels[bytes([k])] for k in range(21)}) == 1 and labels[b"z"] == labels[b"y"] != labels[bytes([0])] and b"q" not in labels


# Passages


def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(30):
        texts = [rng.integers(1, 2**63, rng.integers(8, 50)).astype(np.uint64) for _ in range(3)]
        if trial % 3 == 0:
            texts = [t[rng.integers(0, 4, len(t))] for t in texts]
        stream = np.concatenate([np.append(t, np.uint64(0)) for t in texts])
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        found = set(zip(*(x.tolist() for x in substrings.windows_of(stream, substrings.FACTORS[0], ends, 8)), strict=True))
        expected, at = set(), 0
        for t in texts:
            with np.errstate(over="ignore"):
                h = list(zip((((t * substrings.FACTORS[0]) >> np.uint64(32)) | np.uint64(1)).tolist(), range(len(t)), strict=True))
            for i in range(len(t)):
                a = b = i
                while a and h[a - 1] > h[i]:
                    a -= 1
                while b < len(t) - 1 and h[b + 1] > h[i]:
                    b += 1
                if b - a >= 7:
                    expected.add((a + at, i + at, b + at))
            at += len(t) + 1
        assert found == expected


def test_repeated_passages(spark):
    passage = prose(80, 11)
    rows = [(k, f"{prose(100, 20 + k)} {passage} {prose(60, 40 + k)}") for k in range(6)]
    rows += [(50 + k, prose(200, 60 + k)) for k in range(5)] + [(90, None), (91, ""), (92, passage + " " + passage), (None, passage)]
    found = substrings.repeated_passages(docs_of(spark, rows)).collect()
    hit = {r["doc_id"] for r in found} | {r["other_id"] for r in found}
    assert hit == {0, 1, 2, 3, 4, 5, 92}
    for r in found:
        assert r["similarity"] >= 0.8
        if r["doc_id"] < 10 and r["other_id"] < 10:
            assert r["start"] <= 104 and r["start"] + r["n_words"] >= 176
    assert substrings.repeated_passages(docs_of(spark, [])).count() == 0


def test_repeated_passages_that_no_hub_has(spark):
    passage = prose(60, 31).split()
    parts = lambda k: " ".join(" ".join(passage[x : x + 12]) + " " + prose(7, 1000 * k + x) for x in range(0, 60, 8))
    rows = [(k, parts(k)) for k in (*range(12), *range(90, 102))]
    rows += [(k, f"{prose(80, 300 + k)} {' '.join(passage)} {prose(70, 400 + k)}") for k in (50, 51, 52)]
    found = substrings.repeated_passages(docs_of(spark, rows)).collect()
    assert {(50, 51), (50, 52), (51, 52)} <= {tuple(sorted((r["doc_id"], r["other_id"]))) for r in found}


def test_passages_of_all_different_texts(spark):
    """Texts that share a passage with a third one are held against each other too; a text over again is told once, and a line over and over costs no pair of places."""
    passage = prose(80, 31).split()
    rows = []
    for k in range(6):
        own = list(passage)
        own[8 + 2 * k] = f"changed{k}"
        rows.append((k, f"{prose(70, 100 + k)} {' '.join(own)} {prose(70, 200 + k)}"))
    rows += [(10, rows[2][1]), (11, rows[2][1]), (20, "only a few words"), (21, "only a few words")]
    lines = f"{prose(9, 500)} " * 300
    rows += [(30, f"{prose(60, 300)} {lines}"), (31, f"{lines}{prose(60, 301)}")]
    found = substrings.repeated_passages(docs_of(spark, rows)).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in found}
    assert pairs == {(a, b) for a in range(6) for b in range(a)} | {(10, 2), (11, 2), (31, 30)}
    assert all(r["n_words"] == r["other_n_words"] == 220 and r["similarity"] == 1.0 for r in found if r["doc_id"] in (10, 11))
    assert any(r["n_words"] >= 2690 and r["other_n_words"] >= 2690 for r in found if r["doc_id"] == 31)


def test_passages_by_diagonal():
    rng = np.random.default_rng(6)
    new = lambda n: rng.integers(1, 2**32, n).astype(np.uint32)
    passage = new(60)
    own = np.concatenate([new(40), passage, new(40)])
    found = substrings.verified(own, np.concatenate([new(5), passage[20:23], new(200), passage, new(30)]), 46, 80)
    assert [r[:4] for r in found] == [(40, 99, 208, 267)]
    near = passage.copy()
    near[20:24] = new(4)
    ends = np.concatenate([passage[:3], new(40)])
    found = substrings.verified(np.concatenate([passage, new(12), passage[-20:]]), np.concatenate([ends, near, new(12), new(20)]), 46, 80)
    assert any(a <= 5 and b >= 55 for a, b, *_ in found)
    lines = np.tile(new(4), 1500)
    assert substrings.verified(lines, lines, 46, 80)[0][:2] == (0, 5999)


# Benchmark


def test_leaks(spark):
    items = [(1, prose(40, 70)), (2, prose(30, 71)), (3, "tiny"), (None, prose(40, 72)), (4, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    near = list(items[1][1])
    for k in (20, 60, 100):
        near[k] = "q"
    rows = [(1, f"{prose(50, 80)} {items[0][1].upper()} {prose(9, 81)}"), (2, f"{prose(50, 82)}\n{''.join(near)}"), (3, prose(300, 83)), (4, None), (5, ""), (6, "tiny"), (None, items[0][1])]
    for block_chars in (10_000, 100):
        found = decontaminate.find_leaks(docs_of(spark, rows), benchmark, block_chars).collect()
        assert sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in found) == [("1", 1, 0), ("2", 2, r_distance(found)), ("6", 3, 0), ("None", 1, 0)]
        clean = decontaminate.without_leaks(docs_of(spark, rows), benchmark, block_chars)
        assert clean.columns == [c.split()[0] for c in DOCS.split(", ")]
        assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5]
    assert decontaminate.find_leaks(docs_of(spark, rows), benchmark.limit(0)).count() == 0


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        last, row = row, [i + 1]
        for j, e in enumerate(text):
            row.append(min(last[j] + (c != e), last[j + 1] + 1, row[j] + 1))
    return min(row)


def test_leaks_equal_brute_force():
    """Edited quotes of any length and place, at either end of a text, against all windows of all items."""
    rng, n = random.Random(1), 0
    for _ in range(60):
        letters = "ab cdefghij"[: rng.choice([3, 6, 11])]
        some = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        items = [(i, some(rng.choice([13, 14, 16, 24, 25, 39, 40, 62, 119, 120, 125, 150]))) for i in range(4)]
        texts = []
        for _ in range(4):
            item = decontaminate.normal(rng.choice(items)[1])
            at = rng.randint(0, max(0, len(item) - 120))
            piece = list(item[at : at + rng.choice([120, 130])])
            for _ in range(rng.randint(0, len(piece) // 12 + 1)):
                k = rng.randrange(len(piece))
                piece[k] = rng.choice([rng.choice(letters), "", piece[k] + rng.choice(letters)])
            base = some(rng.randint(0, 120))
            k = rng.randint(0, len(base))
            texts.append(f"{base[:k]}{''.join(piece)}{base[k:]}")
        own = {i: decontaminate.normal(t) for i, t in items if len(decontaminate.normal(t)) >= decontaminate.SHORT}
        found = {(t, i) for t, i, *_ in decontaminate.leaks_in(texts, decontaminate.passages_of(items)) if i in own}
        wanted = set()
        for t, text in enumerate(map(decontaminate.normal, texts)):
            for i, item in own.items():
                m = min(len(item), decontaminate.WINDOW)
                if any(least_distance(item[s : s + m], text) <= int(decontaminate.EDITS * m) for s in range(len(item) - m + 1)):
                    wanted.add((t, i))
        assert found == wanted
        n += len(wanted)
    assert n > 100


def r_distance(found):
    return next(r["distance"] for r in found if r["item_id"] == 2)


def test_alignment_equals_dynamic_programming():
    rng = np.random.default_rng(9)
    patterns = [rng.integers(0, 3, rng.integers(5, 15)).astype(np.uint32) for _ in range(40)]
    regions = [rng.integers(0, 3, 30).astype(np.uint32) for _ in range(40)]
    best, _ = decontaminate.distances(patterns, regions, np.full(40, 30))
    for p, r, d in zip(patterns, regions, best, strict=True):
        cost = np.zeros(len(r) + 1, int)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, x in enumerate(r):
                new.append(min(cost[j] + (c != x), cost[j + 1] + 1, new[j] + 1))
            cost = np.array(new)
        assert d == cost.min()


# Pages


def test_blocks_of_pages():
    assert html_text.blocks_of('<div class=ad>x<p>y</div><div id="main"><p>Hello <i>wor</i>ld &amp; co<br>z<p hidden>no<p>yes</p><ul class="menu"><li>a</ul><form>q</form><!-- c -->t <script>var a="</p>"</script>u</div><div class="comments"><p>bad</div><foo') == ["Hello world & co z", "yes", "t u"]
    assert html_text.blocks_of("<nav><p>menu<article><h1>T</h1><p>one\n two</article><footer>f</footer>") == ["T", "one two"]
    assert html_text.blocks_of(None) == html_text.blocks_of("") == html_text.blocks_of("<script>x") == []


def test_main_texts_without_host_boilerplate(spark):
    notice = "please read our terms of use before you go on today"
    rows = [(k, f"https://a.org/{k}", f"<body><p>{notice}</p><p>{prose(40, 200 + k)}</p></body>") for k in range(12)]
    rows += [(20, "https://b.org/1", f"<p>{notice}"), (21, None, None), (22, "x", ""), (None, "https://a.org/n", "<p>no id</p>")]
    found = {r["page_id"]: r for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k]["text"] == prose(40, 200 + k) and found[k]["n_chars"] == len(found[k]["text"]) for k in range(12))
    assert (found[20]["text"], found[21]["text"], found[22]["text"], found[None]["text"]) == (notice, "", "", "no id")
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(9)
    for n, letters in [(0, 1), (1, 1), (40, 1), (300, 2), (500, 30)]:
        ids = rng.integers(0, letters, n)
        order = html_text.suffix_array(ids)
        assert order.tolist() == sorted(range(n), key=lambda i: ids[i:].tolist())  # noqa: B023
        for k, c in enumerate(html_text.common_prefixes(ids, order)[1:].tolist(), 1):
            x, y = ids[order[k - 1] :], ids[order[k] :]
            m = min(len(x), len(y))
            assert c == next((i for i in range(m) if x[i] != y[i]), m)


def test_boilerplate_equals_brute_force():
    """Against all substrings of all lengths."""
    rng = np.random.default_rng(10)
    for _ in range(15):
        pieces = [rng.integers(0, 40, rng.integers(3, 15)).astype(np.uint32) for _ in range(4)]
        pages = [np.concatenate([rng.integers(0, 40, 9).astype(np.uint32) if rng.random() < 0.4 else pieces[rng.integers(4)] for _ in range(5)]) for _ in range(12)]
        distinct = list({p.tobytes(): p for p in pages}.values())
        held = {}
        for k, p in enumerate(distinct):
            for a in range(len(p)):
                for b in range(a + html_text.RUN, len(p) + 1):
                    held.setdefault(tuple(p[a:b].tolist()), set()).add(k)
        bad = {t for t, own in held.items() if len(own) >= html_text.pages_needed(len(t), len(distinct))}
        runs = {t[i : i + html_text.RUN] for t in bad for i in range(len(t) - html_text.RUN + 1)}
        wanted = sorted(int(html_text.shingle_hashes(np.array(r, np.uint64), html_text.RUN)[0]) for r in runs)
        found = html_text.boilerplate(pages)[0].tolist()
        # What covers words may join two substrings; each of their own runs is found.
        assert set(wanted) <= set(found)


def test_boilerplate_of_hosts(spark):
    """A host of one part and of many clean alike; unique runs stay, and so do copies that were changed here and there."""
    menu = prose(9, 900)
    rows = [(k, "http://a.x/p", f"<div>{menu}</div><div>{prose(30, k)}</div>") for k in range(40)]
    rows += [(100 + k, "http://b.x/p", f"<p>{prose(60, 7)} {'x' * k} {prose(60, 8)}</p>") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("words", F.lit(1))
    most = html_text.PART_PAGES
    try:
        for html_text.PART_PAGES in (512, 12):
            found = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
            assert all(found[k] == prose(30, k) for k in range(40))
            assert all(found[100 + k].split() == f"{prose(60, 7)} {'x' * k} {prose(60, 8)}".split() for k in range(12))
    finally:
        html_text.PART_PAGES = most


def without_names(html):
    """A page whose tags and names no longer tell what is the article."""
    plain = re.sub(r"(</?)(?:nav|header|footer|aside|article|main)\b", r"\1div", html)
    return re.sub(r'\s(?:class|id|role)="[^"]*"', "", plain)


def test_edges_without_telling_tags(spark):
    """Adverts and closing lines that take turns go, a copied article's title and what an article repeats within stay."""
    adverts = [prose(5 + k, 500 + k) for k in range(6)]
    rows = []
    for k in range(36):
        article = 7 if k % 6 == 5 else 100 + k  # every sixth page is a copy of one article
        body = prose(90, article).split()
        body[(k * 7) % 90] = f"changed{k}" if k % 6 == 5 else body[(k * 7) % 90]
        body = " ".join(body)
        text = f"<article><h1>{prose(6, 1000 + article)}</h1><p>{body}</p><p>{adverts[k % 5]} {prose(9, 300 + k)}</p><p>{prose(8, 2000 + k)}</p></article>"
        links = "".join(f"<li>{w}</li>" for w in prose(5, 900).split())
        rows.append((k, f"http://a.x/{k}", f"<nav><ul>{links}</ul></nav><div class=\"ad\">{adverts[(k + k // 6) % 6]}</div>{text}<footer>(c) a.x 2020 {adverts[(k // 6) % 6]}</footer>"))
    wanted = {k: " ".join(html_text.blocks_of(html)) for k, _, html in rows}
    for neutral in (False, True):
        pages = spark.createDataFrame([(k, url, without_names(html) if neutral else html) for k, url, html in rows], "page_id long, url string, html string")
        assert {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()} == wanted


def test_edges_of_the_given_pages(spark, sf_dir="/root/testdata/sf0.1"):
    """Pages with neutral tags: most noise goes, and less than one article word in a hundred."""
    given = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    neutral = spark.createDataFrame([(r["page_id"], r["url"], without_names(r["html"])) for r in given], "page_id long, url string, html string")
    found = {r["page_id"]: Counter(r["text"].split()) for r in html_text.main_texts(neutral).collect()}
    noise = left = words = lost = 0
    for r in given:
        article = Counter(" ".join(html_text.blocks_of(r["html"])).split())
        page = Counter(" ".join(html_text.blocks_of(without_names(r["html"]))).split())
        noise += (page - article).total()
        left += (found[r["page_id"]] - article).total()
        words += article.total()
        lost += (article - found[r["page_id"]]).total()
    assert left < 0.25 * noise and lost < 0.01 * words


def test_edge_blocks_equal_brute_force():
    """What is found at edges stands, word for word, on pages of two groups; groups are those of copies by definition."""
    rng = np.random.default_rng(12)
    for _ in range(20):
        pieces = [rng.integers(0, 60, rng.integers(4, 9)).astype(np.uint32) for _ in range(5)]
        blocks = [[pieces[rng.integers(5)] if rng.random() < 0.5 else rng.integers(60, 5000, rng.integers(4, 20)).astype(np.uint32) for _ in range(rng.integers(2, 6))] for _ in range(9)]
        pages, lengths = [np.concatenate(b) for b in blocks], [np.array([len(x) for x in b], "<u4") for b in blocks]
        text = html_text.HostText(pages)
        group = text.groups(np.zeros(len(text.words), bool))
        found = set(text.edge_blocks(lengths, np.zeros(len(text.words), bool), group).tolist())

        def groups_with(piece):
            n = len(piece)
            return {int(group[k]) for k, p in enumerate(pages) if any(np.array_equal(p[i : i + n], piece) for i in range(len(p) - n + 1))}  # noqa: B023

        wanted = set()
        for own in blocks:
            for side in (own, own[::-1]):
                for piece in side:
                    if len(groups_with(piece)) < html_text.GROUPS:
                        break
                    wanted.add(html_text.whole_hash(piece.astype(np.uint64)))
        titled = any(np.array_equal(a, b[: len(a)]) for own in blocks for a, b in zip(own, own[1:]))
        assert found <= wanted if titled else found == wanted


# Language and toxicity


def test_forward_backward_equals_brute_force():
    rng, k = np.random.default_rng(0), 3
    steps, start = rng.normal(size=(k, k)), rng.normal(size=k)
    lengths = np.array([1, 3, 256, 257, 700])
    scores = rng.normal(size=(lengths.sum(), k)) * 2
    found, pairs = language.Chains(steps, start).marginals(scores, lengths, pairs=True)
    at, total = 0, np.zeros((k, k))
    for n in lengths:
        e = np.exp(scores[at : at + n])
        a, b = np.zeros((n, k)), np.ones((n, k))
        a[0] = np.exp(start) * e[0]
        for t in range(1, n):
            a[t] = a[t - 1] @ np.exp(steps) * e[t]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = np.exp(steps) @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        g = a * b
        assert np.allclose(g / g.sum(1, keepdims=True), found[at : at + n])
        for t in range(n - 1):
            j = a[t][:, None] * np.exp(steps) * (e[t + 1] * b[t + 1])
            total += j / j.sum()
        at += n
    assert np.allclose(total, pairs)


def test_language_of_words_and_texts(spark):
    one, two = ["thor", "with", "thing", "ring", "this"], ["quelle", "chaux", "mieux", "leçon", "réeux"]
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(one if k % 2 else two, 30)), "en" if k % 2 else "fr", "s", 0) for k in range(60)]
    rows += [(100, None, "en", "s", 0), (101, "12 34 !", None, "s", 0), (102, "thing ring with", None, "s", 0), (103, "", "fr", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.learned(docs, F.col("doc_id") < 50)
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(found[k]["lang_pred"] == ("en" if k % 2 else "fr") and 0 <= found[k]["score"] <= 1 for k in range(60))
    assert [found[k]["lang_pred"] for k in (100, 101, 102, 103)] == ["und", "und", "en", "und"]
    mixed = language.Tagger(model).tag([["thing", "with", "ring", "this", "thor", "quelle", "mieux", "chaux", "leçon", "quelle"]])[0].argmax(1)
    assert mixed[0] != mixed[-1]
    kept = language.in_a_language(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(60), 102}
    nothing = language.learned(docs, F.lit(False))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"} and language.in_a_language(docs, nothing).count() == docs.count()


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(300):
        words = rng.choice(WORDS, 60).tolist()
        if k % 3 == 0:
            for at in rng.integers(0, 60, 3):
                words[at] = str(rng.choice(["worthless", "moron", "pathetic"]))
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(k % 3 == 0)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, prose(20, 5) + " worthles moronn " + prose(20, 6), None, None, None)]
    labels += [(None, 1, 1), (5, 1, None)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, marks)
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([found[k]["predicted"] == (k % 3 == 0) for k in held]) > 0.9
    assert found[1000]["predicted"] == found[1001]["predicted"] == 0 and found[1002]["score"] > found[1000]["score"]
    assert toxicity.score_toxicity(docs.limit(0), toxicity.learned(docs, marks.limit(0))).count() == 0
