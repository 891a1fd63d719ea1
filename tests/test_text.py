import random

from gazette.functions import text as X

NBSP, WIDE = " ", "　"


def test_clean_content_drops_tags_and_banners(evaluate):
    raw = [
        "<p>un <b>deux</b></p>",
        "a Ce contenu est bloqué\npar\nx Gérer mes choix b",
        "a Les informations recueillies sont destinées à\ny politique Cookies b",
        "a En poursuivant votre navigation, \r\n les cookies b cookies",
        "a Vous gardez la possibilité de changer à tout moment b",
        f"a{NBSP}b{WIDE}c\x1dd\te\r\n f ",
        "En poursuivant votre navigation sans fin",
        "",
        None,
        "1 < 2 et 3 > 2",
    ]
    assert evaluate(X.clean_content, raw) == [
        "un deux", "a b", "a b", "a b cookies", "a b", "a b c d e f",
        "En poursuivant votre navigation sans fin", "", "", "1 2",
    ]


def test_whitespace_is_the_python_set(evaluate):
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace()]
    assert evaluate(X.collapse_whitespace, [f"a{c}{c}b" for c in spaces]) == ["a b"] * len(spaces)


def test_clean_quotes_keeps_curly(evaluate):
    assert evaluate(X.clean_quotes, ['«a» "b" “c”', None, ""]) == ["'a' 'b' “c”", "", ""]


def test_title_prefix_goes_once(evaluate):
    raw = ["Actualité : a Actualité : b", "x Actualité : y", "z", None]
    assert evaluate(X.clean_title, raw) == ["a Actualité : b", "x y", "z", None]


def cut(text, limit):
    return text if text is None or len(text) <= limit else text[: limit - 3].rsplit(" ", 1)[0] + "..."


def test_truncate_words(evaluate):
    raw = ["abc def ghi jkl", "abcdefghijklmnop", "short", "", None, "é" * 11, "ab cd ef🎉 gh ij"]
    assert evaluate(lambda c: X.truncate_words(c, 10), raw) == [cut(t, 10) for t in raw]


def pack(text, limit):
    """Greedy packing, word by word."""
    done, line, used = [], [], 0
    for word in (text or "").split():
        if used + len(word) + 1 > limit:
            done.append(" ".join(line))
            line, used = [], 0
        line.append(word)
        used += len(word) + 1
    return done + [" ".join(line)] if line else done


def test_chunks_match_word_by_word_packing(evaluate):
    rng = random.Random(7)
    alphabet = ["a", "é", "🎉", "bb", "c" * 11, "d" * 12, "e" * 13, "f" * 30]
    seps = [" ", "  ", "\n", NBSP, WIDE, "\x1d"]
    raw = ["", None, "   ", "d" * 12 + " a", "e" * 40, "a " * 50, f" {'c' * 11}{NBSP}a"]
    for _ in range(200):
        raw.append("".join(rng.choice(alphabet) + rng.choice(seps) for _ in range(rng.randint(1, 25))))
    got = evaluate(lambda c: X.chunk_words(c, 12), raw)
    assert got == [pack(t, 12) for t in raw]
    for chunks, original in zip(got, raw):
        assert " ".join(c for c in chunks if c) == " ".join((original or "").split())


def test_tenth_chunk_carries_the_mark(evaluate):
    raw = ["a " * 10, "a " * 11, "a " * 30, ""]
    capped = evaluate(lambda c: X.cap_chunks(X.chunk_words(c, 2), 10), raw)
    assert capped[0] == ["a"] * 10
    assert capped[1] == capped[2] == ["a"] * 9 + ["a... (contenu tronqué)"]
    assert capped[3] == []


def test_topic_id(spark):
    import hashlib

    rows = spark.createDataFrame([("t", "c"), (None, "c")], "t string, c string")
    got = [r[0] for r in rows.select(X.topic_id(rows["t"], rows["c"])).collect()]
    assert got == [hashlib.md5(s.encode()).hexdigest() for s in ("t c", "None c")]
