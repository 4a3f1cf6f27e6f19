"""Operators on texts against brute force, and what they do with nulls, empty and long texts, repeats and clashing columns."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from proofsieve.llm import bpe, eliasfano, licenses, mixing, ngrams, secrets, simhash, substring, toxicity
from proofsieve.llm.chunks import squeeze, steps, unsqueeze
from proofsieve.llm.components import components
from proofsieve.llm.words import Hasher

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["ta", "ri", "mo", "Ke", "lu", "na", "so", "vi"]) * rng.randint(1, 2) + rng.choice(["", ".", ",", "x"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Passages that repeat, copies, near copies, and the odd cases."""
    rng = random.Random(3)
    passage, base = prose(rng, 80), prose(rng, 200)
    rows = [(k, prose(rng, rng.randint(1, 150)), f"s{k % 4}") for k in range(40)]
    rows += [(100 + k, f"{prose(rng, 30)} {passage}\n{prose(rng, 20)}", "hot") for k in range(8)]
    rows += [(200 + k, base, "hot") for k in range(5)]
    rows += [(300 + k, base + f" {k}", "hot") for k in range(5)]
    rows += [(400, None, None), (401, "", "s1"), (402, " \t\n ", "s2"), (403, "the " * 3000, "s3"), (404, "日本語 テキスト 😀 　x", "s1"), (None, base, "s0"), (None, None, None), (405, passage, "s1"), (405, passage, "s1")]
    return rows


@pytest.fixture(scope="module")
def odd(spark, corpus):
    """The corpus with columns named as the operators name theirs."""
    return table(spark, corpus).selectExpr("*", "1 as chunk", "2 as fp", "'x' as size", "3 as component_id", "4 as kept", "5 as score", "6 as __text", "7 as n_words", "8 as copies", "9 as train", "10 as redacted", "11 as nth", "12 as row", "13 as Copy")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def by_row(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def test_substring_dedup(spark, odd, corpus):
    first = {}
    for i, t, _ in corpus:
        if i is not None:
            w = words(t)
            for p in range(len(w) - 49):
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t, _ in corpus:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        want.append((i, len(w), sum(gone), sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    for chunk_bytes in (2_000, 1 << 20):
        got = substring.dedup(odd, chunk_bytes=chunk_bytes).selectExpr("doc_id", "n_words", "n_removed", "sha2(encode(kept, 'utf-8'), 256)")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 500
    assert substring.report(odd.limit(0)).count() == 0


def test_repeat_lengths(spark, odd, corpus):
    docs = {}
    for i, t, _ in corpus:
        if i is not None:
            docs.setdefault(i, []).append(words(t))
    want, length = {}, 10
    while True:
        where = defaultdict(set)
        for i, texts in docs.items():
            for w in texts:
                for p in range(len(w) - length + 1):
                    where[tuple(w[p : p + length])].add(i)
        level = set().union(*[s for s in where.values() if len(s) > 1])
        if not level:
            break
        want |= dict.fromkeys(level, length)
        length *= 2
    for chunk_bytes in (2_000, 1 << 20):
        assert dict(substring.repeat_lengths(odd, 10, chunk_bytes=chunk_bytes).collect()) == want
    assert max(want.values()) == 160
    assert substring.repeat_lengths(odd.limit(0)).count() == 0


def test_bpe_is_that_of_the_library(spark, odd, corpus):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, ids=True)
    want = []
    for i, t, _ in corpus:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    back = bpe.decode(got, RANKS).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted((i, t or "") for i, t, _ in corpus if i is not None)
    assert bpe.encode(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_replay_on_hard_words():
    codec = bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rng = random.Random(5)
    hard = {"a" * n for n in range(1, 40)} | {"ab" * n for n in range(1, 20)} | {" " * n for n in range(1, 70)} | {"".join(rng.choice("aeinst") for _ in range(rng.randint(1, 30))) for _ in range(2000)}
    for word, ids in codec.encode_words(hard).items():
        assert codec.decode(ids).decode() == word
        assert ids == codec.merge_one(word.encode()) or ids == [codec.ranks[word.encode()]]
        if re.fullmatch(r"[a-z]+", word):
            assert ids == own.encode_ordinary(word)


def test_simhash(spark, odd, corpus):
    def fp(t):
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    ids = sorted({i for i, _, _ in corpus if i is not None})
    of = {i: fp(t) for i, t, _ in corpus if i is not None}
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            root[a] = min(root[b] for b in ids if (of[a] ^ of[b]).bit_count() <= 2)
    want = sorted(((i, f"{fp(t):016x}", None if i is None else root[i]) for i, t, _ in corpus), key=str)
    assert sorted(map(tuple, simhash.report(odd).collect()), key=str) == want
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i in ids if root[i] == i] + [None, None])
    assert simhash.report(odd.limit(0)).count() == 0


def test_simhash_pairs_are_whole(spark):
    rng = random.Random(1)
    fps = {0, -1, 1 << 62}
    while len(fps) < 300:
        f = rng.choice(sorted(fps)) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3))) if rng.random() < 0.7 else rng.getrandbits(63)
        f &= (1 << 64) - 1
        fps.add(f if f < 1 << 63 else f - (1 << 64))
    classes = spark.createDataFrame([(f, k) for k, f in enumerate(sorted(fps))], "fp bigint, rep bigint")
    of = {k: f for k, f in enumerate(sorted(fps))}
    for most, segments in ((2, 2), (3, 2), (2, 3), (1, 1)):
        want = {(a, b) for a in of for b in of if a < b and ((of[a] ^ of[b]) & (1 << 64) - 1).bit_count() <= most}
        got = {tuple(sorted(r)) for r in simhash.near_pairs(classes, most, segments).collect()}
        assert got == want


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (103, 101), (7, 7), (200, 150), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect())
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 103: 100, 200: 150, 150: 150}


def test_secrets(spark, odd, corpus):
    cases = {
        'password: token = abcdefgh12': "named:18:28", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"': "assign:0:49,hex:9:49", "PASSWD=hunter2x": "assign:0:15",
        "AKIAABCDEFGHIJKL99 x": "access:0:18", "AKIASHORT": "", "ſecret=abcdefghij": "", "f" * 40: "hex:0:40", "F" * 40: "",
        'KEY = "Zx9-qLm2Tt7p"\nclient(db_pass=KEY)\n': "constant:7:19", '{"privateKey": "q8Jk2-Lp0Zx7Vb"}': "named:16:30", "url = postgres://bob:S3cr3t-Pa55@db/x": "named:21:32",
        "the token: said nothing": "", "page: one, line: two": "", 'credential_id = "Zx9-qLm2Tt7p"': "", "signing_key := 'AbC123!x9-ZZ'": "named:16:28",
    }
    for text, want in cases.items():
        assert ",".join(f"{k}:{a}:{b}" for k, a, b, _ in secrets.spans(text)) == want, text
    docs = table(spark, [(1000 + k, t, "s") for k, t in enumerate(cases)] + corpus)
    got = {r.doc_id: r for r in secrets.report(docs).collect()}
    for k, want in enumerate(cases.values()):
        base = ",".join(x for x in want.split(",") if x.split(":")[0] in secrets.BASE)
        assert (got[1000 + k].spans, got[1000 + k].base_sha256) == (want, sha256(base.encode()).hexdigest())
    assert got[400].spans == "" and secrets.report(docs.limit(0)).count() == 0
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and sorted(clean.collect(), key=str) == sorted(odd.collect(), key=str)
    red = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert red[1001].text == '[REDACTED]"' and red[1001].n_chars == 11 and red[1008].text == 'KEY = "[REDACTED]"\nclient(db_pass=KEY)\n'


def test_secrets_lexing():
    secret = "Zx9-qLm2Tt7p"
    cases = {
        f'A = "Zx9-"\nB = "qLm2Tt7p"\npassword = A + B\n': "constant:5:9,constant:16:24", f'password = "Zx9-q" + "Lm2Tt7p"': "named:12:17,named:22:29", f"pwd = ('{secret}')": "named:8:20",
        f'# KEY = "{secret}"\ndb_pass = KEY': "", f'# db_pass = "{secret}"': "named:13:25", f'/* db_pass = "{secret}" */ x': "named:14:26", f'x = "db_pass = {secret}"': "named:15:27",
        f'credentials:\n  user: bob\n  value: {secret}\nvalue: {secret}\n': "named:34:46", f'secrets_map = [\n  "{secret}",\n]': "", f'auth_token = [\n  "{secret}",\n]': "named:18:30",
        f'db_pass = os.environ.get("DB_PASSWORD", "{secret}")': "named:41:53", f"run --passphrase {secret} now": "named:17:29", f"<db_pass>{secret}</db_pass>": "named:9:21", 'db_pass = ' + 3 * '"' + secret + 3 * '"': "named:13:25",
        f'K = "{secret}"\nK = load()\ndb_pass = K': "", f'K = "Zx9-"\nK += "qLm2Tt7p"\ndb_pass = K': "constant:5:9,constant:17:25", 'db_pass = db_pass = db_pass': "", 'don\'t: db_pass = x': "",
    }
    for text, want in cases.items():
        assert ",".join(f"{k}:{a}:{b}" for k, a, b, _ in secrets.spans(text)) == want, text


def reference_spans(text):
    """The base kinds, read character by character."""
    plain = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    out, at = [], 0
    while at < len(text):
        name = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(w)].isascii() and text[at : at + len(w)].lower() == w), None)
        best = None
        if name:
            for quoted in ((1, 0) if text[at + len(name) : at + len(name) + 1] in ("'", '"') else (0,)):
                k = at + len(name) + quoted
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in (":", "="):
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ("'", '"')
                    end = k
                    while end < len(text) and text[end] in plain:
                        end += 1
                    if end > k:
                        best = best or (k, end)
        if best:
            if best[1] - best[0] >= 8:
                out.append((at, 0, best[1]))
            at = best[1]
        else:
            at += 1
    for kind, begins, inside, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), (2, "", set("0123456789abcdef"), 32)):
        at = 0
        while at < len(text):
            end = at + len(begins)
            while text.startswith(begins, at) and end < len(text) and text[end] in inside:
                end += 1
            if text.startswith(begins, at) and end > at + len(begins):
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(out)


def test_base_spans_are_those_of_a_plain_reader():
    rng = random.Random(12)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "==", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef", "deadbeef", "x", "Zz9+/", "\n", "ſ", "é", ".-_", "abcdefgh"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        got = [(a, ("assign", "access", "hex").index(k), b) for k, a, b, _ in secrets.spans(text) if k in secrets.BASE]
        assert got == reference_spans(text), text


def test_secrets_planted_in_prose_and_code_are_found():
    rng = random.Random(9)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    forms = ['{n} = "{v}"', "{n}: {v}", '"{n}": "{v}"', "export {N}={v}", "{n} => '{v}'", "<{n}>{v}</{n}>", "--{d} {v}", "K9 = '{v}'\n{n} = K9"]
    hits = wanted = wrong = lines = 0
    for _ in range(2000):
        words = prose(rng, 8)
        v = "".join(rng.choice(letters) for _ in range(rng.randint(14, 30))) + "7x"
        if rng.random() < 0.5:
            n = rng.choice(["db_pass", "privateKey", "client_credentials", "signing_key", "session_key", "auth_bearer"])
            text = f"{words}\n" + rng.choice(forms).format(n=n, N=n.upper(), d=n.replace("_", "-"), v=v) + f"\n{words}"
            wanted += 1
            hits += any(text[a:b] == v for _, a, b, _ in secrets.spans(text))
        else:
            n = rng.choice(["user_id", "title", "colour", "token_count", "password_hint", "checksum", "path"])
            text = f"{words}\n" + rng.choice(forms).format(n=n, N=n.upper(), d=n.replace("_", "-"), v=v) + f"\n{words}"
            lines += 1
            wrong += any(k in ("named", "constant") for k, *_ in secrets.spans(text))
    assert hits / wanted >= 0.97 and wrong / lines <= 0.02, (hits, wanted, wrong, lines)


def test_secrets_in_very_long_texts_take_linear_time():
    long = [
        "x" * 1_000_000 + "://", "://" + "a" * 1_000_000, "a://" * 250_000, 'db_pass = "Zx9-qLm2Tt7p"\n' * 40_000, "password=abcdefgh1 " * 50_000, "a:" * 500_000, "'" * 1_000_000, '"\'`' * 300_000, "/*" * 500_000, "<a>" * 300_000,
        "([{" * 300_000, "x = 'a' + " * 100_000, "a = a + a\n" * 100_000, "# " * 500_000, "\\\n" * 400_000, "K = 'Zx9-qLm2Tt7p'\n" + "db_pass = K + K\n" * 50_000, "a=b" * 300_000, 3 * '"' * 300_000, ("x = " + 3 * "'") * 100_000,
    ]
    for text in long:
        began = time.process_time()
        secrets.spans(text)
        assert time.process_time() - began < 6, text[:20]


def test_toxicity_learns_pairs_and_keeps_to_its_labels(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(1500):
        w = prose(rng, 30).split()
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += ["idiot"] * insult + ["zorgs"] * group
        rng.shuffle(w)
        rows.append((k, " ".join(w), "s"))
        labels.append((k, 1, int(insult and group)))
    docs = table(spark, [*rows, (2000, None, "s"), (2001, "", "s"), (None, "idiot zorgs", "s"), (3, rows[3][1], "s")])
    table_of_labels = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (7, 1, labels[7][2])], "doc_id bigint, quality int, toxic int")
    got = toxicity.report(docs.selectExpr("*", "1 as terms", "2 as score"), table_of_labels).collect()
    assert len(got) == 1504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    right = sum(r.predicted == labels[r.doc_id][2] for r in held)
    assert right / len(held) > 0.97
    # Labels of rows that are held out change nothing.
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    again = toxicity.report(docs, spark.createDataFrame(flipped, "doc_id bigint, quality int, toxic int")).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in again} == {(r.doc_id, round(r.score, 9)) for r in got}
    kept = toxicity.clean(docs.selectExpr("*", "1 as score"), table_of_labels)
    assert kept.columns == [*docs.columns, "score"] and kept.where("doc_id is null").count() == 0 and kept.where("doc_id >= 2000").count() == 2
    none = toxicity.report(docs, table_of_labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.25}
    assert toxicity.report(docs.limit(0), table_of_labels).count() == 0


def test_mixing(spark, odd, corpus):
    got = mixing.report(odd).collect()
    size = {i: len(words(t)) for i, t, _ in corpus if i is not None}
    assert len(got) == len(corpus) and all(r.size == size[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.taken in {0, r.size, 2 * r.size, 3 * r.size} for r in got)
    totals, taken, target = Counter(), Counter(), {}
    by_id = {i: s for i, _, s in corpus if i is not None}
    for r in got:
        if r.doc_id is not None:
            target[by_id[r.doc_id]] = (r.source_size, r.target)
            taken[by_id[r.doc_id]] += r.taken
    for i, t, s in corpus:
        totals[s] += len(words(t))
    names = sorted((s for s in totals if s is not None)) + [None]
    weights = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(totals.values()) - sum(3 * totals[s] for s in capped)
        level = rest / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in names if s not in capped and level * weights[s] > 3 * totals[s]}
        if not more:
            break
        capped |= more
    for s in names:
        want = 3 * totals[s] if s in capped else level * weights[s]
        assert target[s] == (totals[s], pytest.approx(want))
        if s not in ("s0", None):  # these have rows without an id
            sums = {0}
            for n in [len(words(t)) for _, t, x in corpus if x == s]:
                sums = {x + n * k for x in sums for k in range(4)}
            assert abs(taken[s] - want) <= max(1, min(abs(x - want) for x in sums))
    assert sorted(map(str, mixing.report(odd).collect())) == sorted(map(str, got))
    mixed = mixing.mixture(odd)
    assert mixed.columns == odd.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.report(odd.limit(0)).count() == 0 and mixing.mixture(odd.limit(0)).count() == 0
    assert {r.taken for r in mixing.report(table(spark, [(1, None, None), (2, " ", "a")])).collect()} == {0}


def test_knapsack_comes_nearest():
    rng = random.Random(4)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 25), rng.randint(1, 5)))
        counts, budget = [rng.randint(0, 3) for _ in sizes], rng.randint(0, 60)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        took = mixing.knapsack(np.array(sizes), np.array(counts), budget)
        assert (took <= counts).all() and abs((took * sizes).sum() - budget) == min(abs(x - budget) for x in sums)


def test_budget_is_fitted_beside_long_documents():
    longer = 3 * mixing.DP_WORDS
    for sizes, counts, target, want in (([300, 200_000], [500, 1], 175_000, 174_900), ([7, longer], [20_000, 2], 250_000, 249_998), ([70_000, 100_000], [2, 2], 140_000, 140_000)):
        sizes, counts = np.array(sizes), np.array(counts)
        passes, extra = mixing.fit_budget(sizes, counts, float(target))
        assert (passes + (extra > 0) <= mixing.MOST).all() and (extra <= counts).all()
        assert abs(int((sizes * (counts * passes + extra)).sum()) - want) == 0


def test_budgets_of_documents_longer_than_the_program():
    for sizes, counts, target, want in (([140_000], [3], 80_000, 140_000), ([150_000, 200_000], [1, 1], 190_000, 200_000), ([300, 200_000], [500, 1], 175_000, 174_900)):
        passes, extra = mixing.fit_budget(np.array(sizes), np.array(counts), float(target))
        assert int((np.array(sizes) * (passes * np.array(counts) + extra)).sum()) == want


def test_licenses(spark, odd):
    mit = "The MIT Licence (MIT)\n\nCopyright (c) 2020 Someone\n\n" + licenses.MIT.replace("sublicense", "sub-license").lower().replace(". ", ".\n")
    docs = table(spark, [(1, mit, "s"), (2, "Words.\nReleased under the MIT License.\n# SPDX-License-Identifier: ISC\nMore.", "s"), (3, licenses.MIT + " But.", "s"), (4, None, "s"), (5, "Licensed under CC BY-NC 4.0.", "s"), (5, "Licensed under CC BY-NC 4.0.", "s"), (None, "", "s")])
    got = sorted(((r.doc_id, r.license, r.n_notices, r.notices) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([(1, "MIT", 0, ""), (2, None, 2, "ISC,MIT"), (3, None, 0, ""), (4, None, 0, ""), (5, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), (5, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), (None, None, 0, "")], key=str)
    # A long licence is known by its digest alone; without an entry for its text the same rows have none.
    text = licenses.GPL_HEADER.format(v=9) * 3
    long = licenses.canonical(table(spark, [(1, text, "s")]), "text").first()
    known = licenses.known_digests(spark, [], [("Long-1", long.digest, len(" ".join(x for x in long.lines if x)))])
    mine = table(spark, [(1, text.upper().replace(" ", "\n "), "s"), (2, text + " x", "s"), (1, text.upper().replace(" ", "\n "), "s")])
    assert sorted((r.doc_id, r.license, r.n_notices) for r in licenses.scan(mine, known).collect()) == [(1, "Long-1", 0), (1, "Long-1", 0), (2, None, 0)]
    assert len({d for _, d, _ in licenses.LONG}) == len(licenses.LONG) and all(len(d) == 64 and n > 1000 for _, d, n in licenses.LONG)
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(odd).count() == odd.count()


def trigram_scores(corpus):
    """Scores by plain counts, without the quantiser."""
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    tokens = lambda t: [*[w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words(t)], None]
    counts, two, three = Counter(), Counter(), Counter()
    for i, t, _ in corpus:
        if train(i):
            w = [None, *tokens(t)]
            counts.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(counts.values()), len(counts)
    after, after2 = Counter(), Counter()
    for (a, _), c in two.items():
        after[a] += c
    for (a, b, _), c in three.items():
        after2[a, b] += c
    kinds, kinds2 = Counter(a for a, _ in two), Counter((a, b) for a, b, _ in three)
    out = []
    for i, t, _ in corpus:
        w, base, score = [None, *tokens(t)], 0.0, 0.0
        for k in range(1, len(w)):
            p = (counts[w[k]] + 1) / (n + v + 1)
            base += math.log10(p)
            if after[w[k - 1]]:
                p = max(two[w[k - 1], w[k]] - 0.75, 0) / after[w[k - 1]] + 0.75 * kinds[w[k - 1]] / after[w[k - 1]] * p
            if k > 1 and after2[w[k - 2], w[k - 1]]:
                c = after2[w[k - 2], w[k - 1]]
                p = max(three[w[k - 2], w[k - 1], w[k]] - 0.75, 0) / c + 0.75 * kinds2[w[k - 2], w[k - 1]] / c * p
            score += math.log10(p)
        out.append((i, not train(i), len(w) - 1, sum(counts[x] > 0 for x in w[1:]), n, round(base, 6), score))
    return out


def close_to(got, want, total):
    """All but the score equal; the score as near as the quantiser allows, two roundings of half a level a token."""
    order = lambda rows: sorted(rows, key=lambda r: (str(r[:5]), r[6]))
    got, want = order([(*r[:5], round(r[5], 6), r[6]) for r in got]), order(want)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    return all(abs(a[6] - b[6]) <= ngrams.step_of(total) * a[2] for a, b in zip(got, want, strict=True))


def test_ngram_scores(spark, odd, corpus):
    want = trigram_scores(corpus)
    for chunk_bytes in (2_000, 1 << 20):
        got = [tuple(r) for r in ngrams.score(odd, chunk_bytes=chunk_bytes).collect()]
        assert close_to(got, want, want[0][4])
    assert ngrams.score(odd.limit(0)).count() == 0


def test_split_contexts_score_as_whole_ones(spark, corpus, monkeypatch):
    rng = random.Random(7)
    rows = [(k, " ".join(f"a{rng.choice('bcdefghijkl')} of the {rng.choice('mnopqrstuv')}{rng.randint(0, 9)}" for _ in range(40)), "s") for k in range(80)] + corpus
    want = trigram_scores(rows)
    docs = table(spark, rows)
    split, _ = ngrams.dealt_with(docs, 1_000)
    monkeypatch.setattr(ngrams, "LEAST", 8)
    hot = ngrams.vocabulary(split, 12)[1].hot
    assert len(hot.u) >= 4 and (hot.v > 0).any() and hot.parts.max() > 2
    assert close_to([tuple(r) for r in ngrams.score(docs, chunk_bytes=1_000).collect()], want, want[0][4])
    monkeypatch.setattr(ngrams, "LEAST", 1 << 40)
    assert close_to([tuple(r) for r in ngrams.score(docs, chunk_bytes=1_000).collect()], want, want[0][4])


def test_word_hashes_differ_on_words_that_polynomials_mix_up():
    def thue_morse(n, first):
        s = first
        while len(s) < n:
            s += s.translate(str.maketrans("ab", "ba"))
        return s

    hasher = Hasher(seed=1)
    for n in (8, 16, 64, 128, 256, 512, 1024, 2048, 4096):
        raw = np.frombuffer(f"{thue_morse(n, 'a')} {thue_morse(n, 'b')}".encode(), np.uint8)
        hashes, first = hasher(np.array([0, len(raw)]), raw)
        assert first.tolist() == [0, 2] and hashes[0] != hashes[1]
    rng = random.Random(4)
    pool = ["".join(rng.choice("abAB.é\0") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 127, 128, 129, 300]))) for _ in range(3000)]
    raw = np.frombuffer(" ".join(pool).encode(), np.uint8)
    hashes, _ = hasher(np.array([0, len(raw)]), raw)
    of = {}
    assert len(hashes) == len(pool) and all(of.setdefault(w, h) == h for w, h in zip(pool, hashes.tolist(), strict=True)) and len(set(of.values())) == len(of)
    lower, _ = Hasher(seed=1, lower=True)(np.array([0, len(raw)]), raw)
    again = np.frombuffer("".join(c.lower() if c.isascii() else c for c in " ".join(pool)).encode(), np.uint8)
    assert (lower == hasher(np.array([0, len(again)]), again)[0]).all()


def test_squeezed_arrays_come_back():
    rng = np.random.default_rng(2)
    given = [np.zeros(0, np.int64), np.arange(5), rng.integers(0, 1 << 62, 1000), np.array([1 << 40]), np.zeros(3, np.uint8)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(given, unsqueeze(squeeze(given)), strict=True))
    hashes = np.sort(rng.integers(0, 1 << 63, 100, np.uint64) * np.uint64(2))
    assert (np.cumsum(unsqueeze(squeeze([steps(hashes)]))[0].view(np.uint64)) == hashes).all()


def test_elias_fano():
    rng = np.random.default_rng(0)
    for universe, n in ((10, 5), (1 << 63, 1000), (1 << 20, 50_000), (1 << 63, 1), (5, 0), (1 << 40, 3000)):
        v = np.unique(rng.integers(0, universe, n).astype(np.uint64)) if n else np.zeros(0, np.uint64)
        e = eliasfano.EliasFano(*eliasfano.unpack(eliasfano.pack(eliasfano.EliasFano.of(v).arrays())))
        asked = np.r_[v, rng.integers(0, universe, 2000).astype(np.uint64)]
        place, found = e.successor(asked)
        assert (found == np.isin(asked, v)).all() and (v[place[found]] == asked[found]).all()
        assert (e.access(np.arange(len(v))) == v).all() and (e.values() == v).all() and len(e.values()) == len(v)
    v = np.sort(rng.integers(0, 100, 1000)).astype(np.uint64)
    assert (eliasfano.EliasFano.of(v).access(np.arange(1000)) == v).all()


def test_tries_hold_the_model(spark, corpus):
    docs = table(spark, corpus)
    blobs = ngrams.tries(docs, chunk_bytes=4_000).collect()
    tries = [ngrams.Trie.view(bytes(r.trie)) for r in blobs]
    train = [t for i, t, _ in corpus if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    lists = [[None, *words(lower(t)), None] for t in train]
    # A split pair's trigrams stand in level two, below the pair.
    every = len({x for w in lists for x in zip(w, w[1:], strict=False)}) + len({x for w in lists for x in zip(w, w[1:], w[2:], strict=False)})
    assert sum(len(t.terms) + len(t.third_terms) for t in tries) == every


def test_raw_scores_are_sums_over_pairs():
    rng = np.random.default_rng(6)
    machine = toxicity.Machine(np.arange(7, dtype=np.int32), 0.3, rng.normal(size=7), rng.normal(size=(7, 3)))
    texts = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5, 6]]
    rows, terms = np.repeat(np.arange(4), [len(t) for t in texts]), np.array(sum(texts, []))
    pairs = lambda t: sum(machine.factors[i] @ machine.factors[j] for k, i in enumerate(t) for j in t[k + 1 :])
    want = [machine.bias + sum(machine.linear[i] for i in t) + pairs(t) for t in texts]
    assert np.allclose(machine.raw(rows, terms, 4), want)


def test_penalty_keeps_its_force():
    """A word that alone tells the classes apart is kept and others aren't, whether the rows are few or many."""
    for n in (60, 4000):
        rng = np.random.default_rng(n)
        y = (np.arange(n) % 6 == 0).astype(float)
        rows = [np.unique(np.r_[rng.integers(1, 200, 30), [0] * int(v)]) for v in y]
        ends, terms = np.r_[0, np.cumsum([len(r) for r in rows])], np.concatenate(rows).astype(np.int64)
        machine = toxicity.fit_weights(y, ends, terms, 256, 4, 5, 1.0, 0.5, 0.1)
        score = toxicity.sigmoid(machine.raw(np.repeat(np.arange(n), np.diff(ends))[machine.place[terms] >= 0], machine.place[terms][machine.place[terms] >= 0], n))
        assert ((score >= 0.5) == (y == 1)).all() and machine.linear[machine.place[0]] == machine.linear.max()
        assert toxicity.held_loss(y, ends, terms, 0.5, 256, 4, 5, 1.0, 0.1) < 0.2


def test_training_rows_are_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    y, ends, terms = toxicity.training(docs, labels, 1 << 18, 1000, 1 << 30)
    few, _, small = toxicity.training(docs, labels, 1 << 18, 1000, 4 * len(terms) // 4)
    assert len(y) > 200 and len(ends) == len(y) + 1 and 0 < len(few) < len(y) // 2 and len(small) < len(terms) // 2
