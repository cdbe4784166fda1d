"""URL filter, quality rules and line de-duplication against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quantloom.llm import line_dedup, quality, url_filter


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- URL filter


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("allow", "a.b.example.com", "/"), ("block", "example.com", "/de/x"), ("block", "xample.com", "/"), ("allow", "net", "/")]


@pytest.mark.parametrize("ranges", [64, 3])
def test_urls_match_plain_python(spark, monkeypatch, ranges):
    monkeypatch.setattr(url_filter, "RANGES", ranges)
    monkeypatch.setattr(url_filter, "RANGE_HOSTS", 1)
    rng = random.Random(2)
    hosts = ["net", "example.net", "EXAMPLE.com", "a.b.example.com", "x.a.b.example.com", "notexample.com", "org", "é.org", "b.example.com", "", "example.com:80", "zz", "a..net"]
    urls = [f"{rng.choice(['http', 'https', 'X'])}://{rng.choice(['', 'www.', 'm.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/1', '/de/xy', '/de', '/fr/?/en/', '?q=/en/', '#/de/', '/en/://z'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://net/", "http:/net/", "a?b://example.net/en/", "http://net/\n/x"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = sorted(map(tuple, url_filter.judge_urls(pages, url_filter.rule_table(spark, RULES)).collect()))
    assert got == [(i, *judge(u, RULES)) for i, u in enumerate(urls)]
    none = url_filter.judge_urls(pages, url_filter.rule_table(spark, []), "block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")} and len(none) == len(urls)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, RULES)).collect() == []


# --- quality rules


def measure(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    n = len(w)
    failed = n < 50 or 100 * len(again) > 50 * n
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def verdicts(rows):
    """kept by doc_id, from the rules of README and docstring alone."""
    own, hosts = {}, defaultdict(list)
    for i, t, host, _ in rows:
        n, chars, symbols, dup, again, failed = measure(t)
        lines = sum(bool(words(x)) for x in (t or "").split("\n"))
        fails = (n < 50, 100 * again > 50 * n, 10 * symbols > n, 100 * dup > 30 * lines, chars < 2 * n or chars > 15 * n)
        own[i] = (failed, fails, host)
        hosts[host].append(fails)
    strict, whole = defaultdict(set), set()
    for r in range(5):
        k = {h: sum(f[r] for f in own_) for h, own_ in hosts.items()}
        mean = sum(k.values()) / len(rows)
        spread = sum(k[h] ** 2 / len(hosts[h]) for h in hosts) / len(rows) - mean**2
        weight = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
        for h, x in k.items():
            rate = (x + mean * weight) / (len(hosts[h]) + weight)
            if rate > 1.25 * mean:
                strict[h].add(r)
            if rate > 0.95:
                whole.add(h)
    return {i: not failed and h not in whole and not any(fails[r] and r in strict[h] for r in (2, 3, 4)) for i, (failed, fails, h) in own.items()}


def test_quality_matches_plain_python(spark):
    rng = random.Random(4)
    vocab = ["a", "bé", "#c", "日本", "d$", "x", "y", "z"] + [f"w{k}" for k in range(300)]
    texts = ["".join(rng.choice(vocab[: rng.choice([3, 8, 300])]) + rng.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += [None, "", " \n", "a b", "a b c", "a b c a b c", "\n\nq\nq\n q\n", "word " * 5000, "\x85 \xa0", " ".join(f"u{k}" for k in range(20000))]
    rows = [(i, t, None if i % 10 == 0 else f"s{i % 7}", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows)
    kept = verdicts(rows)
    for i, t, _, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measure(t), (i, t[:50] if t else t)
        assert r.kept == kept[i]
    assert quality.judge(docs.limit(0)).collect() == []


def test_a_bad_host_is_rejected_and_a_small_one_is_not(spark):
    good = " ".join(f"word{k}" for k in range(80))
    bad = "x"
    rows = [(i, bad, "bad") for i in range(400)] + [(1000, good, "bad")] + [(2000 + i, good, f"h{i % 9}") for i in range(500)] + [(5000, bad, "tiny"), (5001, good, "tiny")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1000].host_rejected and not got[1000].kept and not got[1000].base_failed
    assert got[5001].kept and got[2000].kept


@pytest.mark.parametrize("bad_of_100", [60, 90])
def test_a_mostly_bad_host_loses_what_fails_there(spark, bad_of_100):
    clean, junk = " ".join(f"word{k}" for k in range(80)), " ".join(f"#{k}" for k in range(80))
    rows = [(i, junk if i < bad_of_100 else clean, "bad") for i in range(100)] + [(1000 + i, junk if i == 0 else clean, f"h{i % 9}") for i in range(900)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept == (t == clean) for i, t, h in rows if h == "bad") and not got[0].base_failed
    assert all(got[i].kept for i, _, h in rows if h != "bad")


# --- lines


def brute(rows, least):
    seqs = {i: [(no, x, len(words(x))) for no, x in enumerate((t or "").split("\n")) if words(x)] for i, t in rows}
    seen, gone = set(), defaultdict(set)
    for i in sorted(seqs):
        s = seqs[i]
        for k in range(len(s)):
            for e in range(k, len(s)):
                run = tuple(x for _, x, _ in s[k : e + 1])
                if run in seen and sum(n for _, _, n in s[k : e + 1]) >= least:
                    gone[i] |= {no for no, _, _ in s[k : e + 1]}
                seen.add(run)
    return {i: (None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[i]), len(gone[i])) for i, t in rows}


@pytest.mark.parametrize(("seed", "least"), [(1, 10), (2, 5), (3, 1)])
def test_lines_match_brute_force(spark, seed, least):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 1, 2, 3, 4, 11]))) for _ in range(14)]
    texts = []
    for _ in range(60):
        lines = [rng.choice([rng.choice(pool), rng.choice(pool), f"own {rng.random()}", "", " \t"]) for _ in range(rng.randint(0, 14))]
        if texts and rng.random() < 0.3:
            old = (rng.choice(texts) or "").split("\n")
            a = rng.randint(0, len(old))
            lines[2:2] = old[a : a + rng.randint(1, 8)]
        texts.append("\n".join(lines))
    texts += [None, "", "\n", "a b c d e f g h i j k", "a b c d e f g h i j k\n", "x y\n" * 40, "é\r\n" * 3]
    rows = [*enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(t, i, "n", 3) for i, t in rows], "text string, doc_id long, marks string, k int")
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.delete_repeats(docs, least).collect()}
    assert got == brute(rows, least)


def test_no_lines(spark):
    assert line_dedup.delete_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_and_clashing_names(spark):
    run = "the one two three four five six seven eight nine ten"
    rows = [(1, run, 5, "x"), (2, f"{run}\nown b", 6, "y"), (2, f"{run}\nown b", 6, "y"), (2, f"else\n{run}", 7, "z"), (3, None, 8, "a"), (None, run, 9, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_deleted int, `a.b` string")
    out = line_dedup.delete_repeats(docs)
    assert out.columns == ["doc_id", "text", "a.b", "n_deleted"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, run, "x", 0), (2, "own b", "y", 1), (2, "own b", "y", 1), (2, "else", "z", 1), (3, None, "a", 0), (None, run, "b", 0)], key=str)
    assert line_dedup.delete_in_place(docs).columns == docs.columns


def test_repeated_and_unnamed_pages(spark):
    pages = spark.createDataFrame([(1, "x://a.net/"), (1, "x://a.net/"), (None, "x://org/fr/1")], "page_id long, url string")
    got = sorted(map(tuple, url_filter.judge_urls(pages, url_filter.rule_table(spark, RULES[:1])).collect()), key=str)
    assert got == sorted([(1, "a.net", "/", "net/", "block")] * 2 + [(None, "org", "/fr/1", None, "allow")], key=str)
