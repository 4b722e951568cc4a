import os
import random
import re

from foundling.llm import quality


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(hit)


def prose(rng, n):
    vowels, rest = "aeiou", "bcdfglmnprst"
    return " ".join("".join(rng.choice(rest) + rng.choice(vowels) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_base_counts(rows_of_text):
    rng = random.Random(1)
    texts = [None, "", "a b c a b c", "x\n\nx\n \nx", "é #*$%&|<> ü", "a a a a", "l1\nl2\nl1\r\nl1", "q w e r q w e", "   ",
             prose(rng, 60) + "\n" + prose(rng, 5)] + [" ".join(rng.choice("ab") for _ in range(n)) for n in (2, 3, 4, 9, 40)]
    out = {r.doc_id: r for r in quality.judge(rows_of_text(texts)).select("row.doc_id", "*").collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_base(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.judge(rows_of_text([])).count() == 0


def test_bands(rows_of_text):
    rng = random.Random(2)
    good = [prose(rng, n) for n in (50, 200, 1000, 20000)]
    # words differ, yet a compressor finds the same block again and again; and the reverse
    block = [prose(rng, 1) + str(i) for i in range(40)]
    same = " ".join(block[(i * 7) % 40] + " " + block[(i * 11) % 40][:3] for i in range(20000))
    noise = " ".join(os.urandom(30).hex() for _ in range(1)) + " ".join("".join(chr(rng.randint(33, 126)) for _ in range(40)) for _ in range(400))
    out = {r.doc_id: r for r in quality.judge(rows_of_text(good + [same, noise, good[0]])).select("row.doc_id", "*").collect()}
    assert all(out[i].kept and out[i].verdict == "" for i in range(4))
    assert not out[5].kept and out[5].verdict == "incompressible"
    assert out[6].kept
    assert quality.outside(10_000, 100) == "repetitive" and quality.outside(100, 3) == "" and quality.outside(5000, 4900) == "incompressible"
