import re
from collections import Counter, defaultdict

import pytest

from pagemill.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def norm(line):
    return " ".join(WORDS.findall(re.sub("[0-9]+", "0", line.lower())))


def verdicts(rows, limit, percent=50):
    """(doc, base, kept) by brute force; rows are (doc_id, text, host)."""
    held = defaultdict(set)
    for _, text, host in rows:
        lines = tuple(norm(x) for x in (text or "").split("\n") if WORDS.search(x))
        for x in set(lines):
            held[host, x].add(lines)
    out = []
    for doc_id, text, host in rows:
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        lost = sum(len(WORDS.findall(x)) for x in lines if len(held[host, norm(x)]) > limit)
        b = base(text)
        out.append((doc_id, *b, lost, not b[5] and 100 * (b[0] - lost) >= percent * b[0]))
    return out


def got(df):
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_common_words kept".split()
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_against_brute_force(documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    for limit in (10, 1):
        assert got(quality.quality_rules(documents, max_docs=limit)) == sorted(verdicts(rows, limit), key=repr)


def test_depleted_documents_go_and_copies_do_not_count(make):
    menu = " ".join("menu" + "q" * i for i in range(40))
    own = lambda k: " ".join("abcdefgh"[k] + "xyz"[i % 3] * (1 + i) for i in range(30))
    rows = [(k, f"{menu} 7{k}\n{own(k)}", "en", "host") for k in range(5)]
    rows += [(10 + k, f"{menu} 7\n{own(k)}", "en", "other") for k in range(2)]
    copy = "\n".join(" ".join("cde"[j] + "w" * (i + 1) for i in range(30)) for j in range(3))
    rows += [(20 + k, copy, "en", "copies") for k in range(6)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(make(rows), max_docs=3).collect()}
    assert not any(kept[k] for k in range(5))
    assert all(kept[k] for k in (10, 11, *range(20, 26)))


@pytest.mark.parametrize("k, pages", [(10, 50), (20, 50), (40, 200)])
def test_pages_that_are_mostly_furniture_go(make, k, pages):
    words = lambda tag, n: " ".join(f"{tag}{chr(97 + i)}" for i in range(n))
    furniture = [words("menu" + "abcdefghij"[i % 10] * (1 + i // 10), 6) for i in range(k)]
    rows = [(p, "\n".join([*furniture[p % k :], words("own" + "xyz"[p % 3] * (1 + p // 3), 8), *furniture[: p % k]]), "en", "host") for p in range(pages)]
    rows += [(1000 + p, "\n".join(words("good" + "xyz"[p % 3] * (1 + p // 3) + "klmnop"[j], 12) for j in range(6)), "en", "host") for p in range(20)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(make(rows)).collect()}
    assert not any(kept[p] for p in range(pages))
    assert all(kept[1000 + p] for p in range(20))
    assert got(quality.quality_rules(make(rows))) == sorted(verdicts([(r[0], r[1], r[3]) for r in rows], 10), key=repr)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert got(quality.quality_rules(odd)) == sorted(verdicts(rows, 10), key=repr)
    assert quality.quality_rules(nothing).count() == 0


def test_no_python_in_the_plan(documents):
    plan = quality.quality_rules(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
