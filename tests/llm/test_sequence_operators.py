"""Cost-balanced packing, fill in the middle and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF, SMALL
from tests.oracle import connect, differences
from tickspark.llm import balanced, fim, trie
from tickspark.llm.common import read

# --- 11: packing


def check_plan(lengths, capacity):
    """Every row exactly once, sequences without gaps or padding; returns rows that are cut."""
    histogram = Counter(lengths)
    plan = balanced.Plan(histogram, capacity)
    edges, begin, runs = plan.tables()
    sequences, row, cut = defaultdict(list), 0, 0
    for length in sorted(histogram):
        for r in range(row, row + histogram[length]):
            at = np.searchsorted(edges, r, side="right") - 1
            mine = runs[begin[at] : begin[at + 1]]
            assert [s[2] for s in mine] == [0, *np.cumsum(mine[:, 3])[:-1]] and mine[:, 3].sum() == length
            cut += len(mine) > 1
            for s in mine.tolist():
                sequences[s[4] + r - s[0]].append((s[5], s[3]))
        row += histogram[length]
    assert sorted(sequences) == list(range(plan.sequences))
    for places in sequences.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end == capacity or (end < capacity and end & (end - 1) == 0)
    return cut, sequences


@pytest.mark.parametrize("draw", [
    lambda g: g.integers(1, 65, 400), lambda g: np.ones(100, int), lambda g: np.full(70, 40), lambda g: np.full(9, 64),
    lambda g: np.minimum(64, g.lognormal(3, 1, 900).astype(int) + 1), lambda g: np.array([5]),
])
def test_plan_fills_every_sequence(draw):
    check_plan(draw(np.random.default_rng(3)).tolist(), 64)


def test_plan_equals_a_greedy_loop_over_single_pieces():
    lengths = sorted(np.random.default_rng(5).integers(1, 20, 64).tolist(), reverse=True)
    lengths += [1] * (-sum(lengths) % 64)
    cost, used = defaultdict(int), defaultdict(int)
    total = sum(lengths) // 64
    for n in lengths:
        if not (fits := [s for s in range(total) if used[s] + n <= 64]):
            break
        best = min(fits, key=lambda s: cost[s])
        cost[best] += balanced.LINEAR * n + n * n
        used[best] += n
    else:
        _, sequences = check_plan(lengths, 64)
        planned = sorted(sum(balanced.LINEAR * n + n * n for _, n in p) for p in sequences.values())
        assert planned == sorted(cost.values())
        return
    pytest.fail("the lengths were chosen to need no cut")


def test_plan_grows_with_lengths_and_not_with_pieces():
    few = Counter(np.minimum(2048, np.random.default_rng(1).lognormal(6.3, 1, 20000).astype(int) + 1).tolist())
    many = {n: 100_000 * k for n, k in few.items()}
    assert len(balanced.Plan(many).runs) < 3 * len(balanced.Plan(few).runs)


def test_packed_pieces_hold_the_library_ids(spark, odd_docs):
    t = Tokenizer.from_file(balanced.tokenizer_path())
    special = spark.createDataFrame([(77, "a <|endoftext|> b<|startoftext|>")], "doc_id long, text string")
    for docs in (read(spark, SMALL, "documents").select("doc_id", "text"), odd_docs.select("doc_id", "text").unionByName(special)):
        rows = balanced.pack_documents(docs, balanced.tokenizer_path(), capacity=256, with_ids=True).toPandas()
        want = Counter()
        for r in docs.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [balanced.END]
            want[r.doc_id, np.array(ids, "<u4").tobytes()] += 1
        got = Counter()
        # Equal ids may stand for several rows; these have equal pieces, so they are put together greedily.
        for doc_id, pieces in rows.groupby("doc_id", dropna=False):
            assert all(zlib.crc32(np.array(i, "<u4")) == c and len(i) == n for i, c, n in zip(pieces.ids, pieces.ids_crc32, pieces.length))
            by_start = defaultdict(list)
            for p in pieces.itertuples():
                by_start[p.start, p.doc_tokens].append(p)
            for (start, n), first in by_start.items():
                for p in first if start == 0 else []:
                    ids, at = list(p.ids), p.length
                    while at < n:
                        q = by_start[at, n].pop()
                        ids, at = ids + list(q.ids), at + q.length
                    got[None if doc_id is None or np.isnan(doc_id) else int(doc_id), np.array(ids, "<u4").tobytes()] += 1
        assert got == want
        for _, s in rows.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 256
        whole = balanced.assemble(balanced.pack_documents(docs, balanced.tokenizer_path(), capacity=256, with_ids=True))
        assert whole.select(F.sum(F.size("ids"))).first()[0] == rows.length.sum()


def test_op11_pads_nothing(spark):
    rows = balanced.op11(spark, SF).toPandas()
    fill = rows.groupby("sequence_id").length.sum()
    assert all(n & (n - 1) == 0 and n <= 2048 for n in fill) and (fill < 2048).sum() <= 11
    assert rows.groupby("doc_id").length.sum().equals(rows.groupby("doc_id").doc_tokens.first().rename("length"))


def test_packing_nothing(spark, no_docs):
    assert balanced.pack_documents(no_docs, balanced.tokenizer_path()).count() == 0


# --- 12: fill in the middle


def plain_fim(doc_id, text, unit):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.MARKS):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def hard_texts():
    rng = random.Random(4)
    letters = ["a", "\n", "é", "日", "😀", "<", "P", ">", "S", "M", " ", "\x80", "\x8a", "Ċ", "\x0b", "\x01", "\r"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 15, 16, 17, 60, 300]))) for _ in range(300)]
    return texts + ["\n", "\n\n", "x\n", "\nx", "\n" * 64, "a" * 64, "<P>", "x<S>y\n", "<<", None, "日" * 40, "\x0a\x0b\x09\x8a" * 20]


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fim_equals_plain_cuts(spark, odd_docs, unit):
    rows = [(k if k % 17 else None, t) for k, t in enumerate(hard_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    got = fim.transform(docs, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((r.doc_id, *plain_fim(r.doc_id, r.text, unit), r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_rates(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('a\\n', id, '\\nb') as text")
    forms = {r: {x.form for x in fim.transform(docs, rate=r[0], spm=r[1]).collect()} for r in ((0, 50), (100, 0), (100, 100), (50, 50))}
    assert forms == {(0, 50): {"plain"}, (100, 0): {"psm"}, (100, 100): {"spm"}, (50, 50): {"plain", "psm", "spm"}}


def test_in_word_select():
    raw = np.frombuffer(b"\n\n" + b"x" * 13 + b"\n" + b"\x8a\x0b\x09\x00" * 8 + b"\n" * 9, np.uint8)
    ends = fim.Marked(fim.line_ends(fim.as_words(raw)))
    at = np.flatnonzero(raw == 10)
    assert ends.select(np.arange(1, len(at) + 1)).tolist() == at.tolist()
    assert ends.rank(np.arange(len(raw) + 1)).tolist() == [(at < k).sum() for k in range(len(raw) + 1)]


def test_op12_sql(spark):
    assert differences(fim.op12(spark, SF).toPandas(), connect(SF).execute(fim.OP12_SQL).df()) is None


def test_fim_of_nothing(spark, no_docs):
    assert fim.transform(no_docs).count() == 0


# --- 13: conversation trie


def plain_trie(rows):
    """Nodes by their sequences, as (smallest member, depth, parent, members, children, leaves, saved, ends)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
        own[c].append(((turn is not None, turn or 0), digest, role, text))
    for c in own:
        own[c] = [(role, text) for *_, role, text in sorted(own[c])]
    built = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = [] if c is None else own.get(c - int(np.fmod(c, 5)), [])
        built[c] = tuple(base[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    small = {s: min((c for c in m if c is not None), default=None) for s, m in members.items()}
    children = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if c is not None) if built[c] == s)
        out.append((small[s], len(s), small[s[:-1]] if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def trie_rows(df):
    return Counter(tuple(r[c] for c in trie.RESULT) for r in trie.prefix_trie(*trie.rebuild(df)).collect())


def made(seed, n, longest, words=2):
    """Conversations with few words, so that many share long beginnings; some end inside others or equal them."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        size = rng.choice([1, 2, 3, 15, 16, 17, 31, 32, 33, longest])
        like = rng.randrange(3)
        for t in range(size):
            text = f"w{like}" if t < 20 else f"w{rng.randrange(words)}"
            rows.append((c, t, rng.choice(["user", "user", "bot"]) if t == 30 else "user", text * (1 + t % 3)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, shard", [(1, 3), (2, 9), (3, 40_000)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(trie, "SHARD_ROWS", shard)
    rows = made(seed, 45, 70)
    assert trie_rows(conversations(spark, rows)) == plain_trie(rows)


def test_trie_of_odd_turns(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_ROWS", 2)
    rows = [
        (None, 0, "user", "x"), (None, 1, "user", "y"), (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "bot", "x"),
        (2, 3, "user", ""), (3, 1, "user", "x" * 100_000), (-3, 0, "user", "x"), (-5, 0, "é", "日本"), (-5, 1, "é", "日本"), (0, 0, "us", "erx"),
        (0, 1, "user", "x"), (10**12, 5, "user", "x"), (10**12 + 4, 5, "user", "x"),
    ]
    df = conversations(spark, rows).withColumns({c: F.lit("clash") for c in ("conv", "pos", "key", "part", "block", "digest")})
    assert trie_rows(df) == plain_trie(rows)


def test_trie_of_equal_and_of_no_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_ROWS", 4)
    rows = [(c, t, "user", f"t{t}") for c in range(60) for t in range(18)]
    assert trie_rows(conversations(spark, rows)) == plain_trie(rows)
    assert trie_rows(conversations(spark, rows[:0])) == Counter()


def test_op13_sql(spark):
    assert differences(trie.op13(spark, SF).toPandas(), connect(SF).execute(trie.OP13_SQL).df()) is None
