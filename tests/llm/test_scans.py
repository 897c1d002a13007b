"""License scan, token counts, quality rules."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.common import docs, lower, rows, words

from epsforest.llm import license_scan as ls
from epsforest.llm import quality_rules as qr
from epsforest.llm import token_counts as tc
from epsforest.llm.queries import _pattern
from epsforest.llm.textscan import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def machine():
    with open(MODEL, "rb") as f:
        return tc.Transducer(tc.read_model(f.read()))


TEXT = st.lists(st.sampled_from([*"abeT  \n\n\t\r▁é😀中<s>{}();.\x00", "the", "tion", " \r", "\n\n", "  ", "aaaa", "----"]), max_size=60).map("".join)


def in_blocks(machine, texts, size=1 << 20):
    return [int(n) for _, _, buf, offs in pieces(pa.array(texts), size) for n in machine.rows(buf, offs)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(1, 9))
def test_tokens_equal_the_library(machine, library, texts, size):
    want = [len(x) for x in library.encode(texts)]
    assert in_blocks(machine, texts, 16) == want
    assert [machine.long(t.encode(), size) for t in texts] == want


def test_blanks_and_stretches_without_a_free_place(machine, library, monkeypatch):
    rng = random.Random(4)
    texts = [a + " " * n + b for n in range(70) for a, b in (("", ""), ("a", "b"), ("\n", ""))]
    texts += ["a" * 5001, "ab" * 3000, "-" * 4000, "0" * 1025, "abc" * 2000, "".join(rng.choice("abcdefgh0123+/") for _ in range(9000))]
    want = [len(x) for x in library.encode(texts)]
    for rounds, width in ((4, 64), (0, 64), (0, 1)):  # entered anew, by the prefix scan of maps, chunk by chunk
        monkeypatch.setattr(tc, "ROUNDS", rounds)
        monkeypatch.setattr(tc, "WIDTH", width)
        assert in_blocks(machine, texts) == want
    assert [machine.long(t.encode(), 777) for t in texts] == want


def test_transitions_add_up_to_the_last_piece(machine, library):
    text, state, total = "▁unbelievable▁internationalisation", 0, 0
    for i, ch in enumerate(text):
        state, emitted = machine.step(0 if ch == "▁" else state, int(machine.class_of[ord(ch)]))
        total += emitted
        want = library.encode(text[1 : i + 1], out_type=str) if i else ["▁"]
        assert (total, machine.v.pieces[machine.states[state][0]]) == (len(want), want[-1])


def test_unfit_vocabularies_are_refused():
    for found, rank in ((["a", "b", "abc"], {"abc": 1.0}), (["a", "▁", "a▁"], {"a▁": 1.0}), (["a", "b", "c", "abc"], {"abc": 1.0})):
        with pytest.raises(ValueError):
            tc.Vocabulary(found, rank).close()


def test_token_rows(spark, library):
    texts = [None, "", "a  b\nc", "x y " * 9000, "▁▁ <s>", "a  b\nc", "long " * 600_000]
    got = rows(tc.count_tokens(docs(spark, texts), MODEL))
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096)
    assert tc.count_tokens(docs(spark, texts).limit(0), MODEL).count() == 0


def longest(template, text):
    machine = ls.Scanner({}, {"x": [template]})
    buf = np.frombuffer(text.encode(), np.uint8)
    return sorted(machine.scan(buf, np.array([0, len(buf)]))["regions"][0])


def test_markup():
    template = "copyright [[c]] {{owner:1-3}} all rights"
    for text, found in (("copyright c me all rights", [(0, 5)]), ("x copyright me you all rights", [(1, 6)]), ("copyright all rights", []), ("copyright a b c d all rights", []), ("copyright c all rights x", [(0, 4)])):
        assert longest(template, text) == found
    assert longest("a [[b [[c]] d]] e", "a b c d e a e a b d e a b c e") == [(0, 5), (5, 7), (7, 11)]
    for bad in ("[[a]] b", "a [[b", "a ]] b", "a {{x:3-1}}", ""):
        with pytest.raises(ValueError):
            ls.parse(bad)


def instances(template, rng):
    """A text that the template accepts, and its mandatory words' places; made by replacing marks in the template's text."""
    out, skip, mandatory = [], 0, []
    for part in re.split(r"(\[\[|\]\]|\{\{.*?\}\})", template):
        if part == "[[":
            skip += 1 if skip or rng.random() < 0.5 else 0
        elif part == "]]":
            skip -= 1 if skip else 0
        elif skip:
            continue
        elif part.startswith("{{"):
            least, most = map(int, part[part.index(":") + 1 : -2].split("-"))
            out += [f"zq{rng.randrange(99)}" for _ in range(rng.choice((least, most)))]
        else:
            found = re.findall("[a-z0-9]+", part.lower())
            mandatory += range(len(out), len(out) + len(found))
            out += found
    return out, mandatory


@pytest.mark.parametrize("label", sorted(ls.TEMPLATES))
def test_every_template_takes_its_wording_and_no_other(label):
    rng = random.Random(label)
    for template in ls.TEMPLATES[label]:
        for _ in range(6):
            found, mandatory = instances(template, rng)
            ends = [b for a, b in longest(template, "zz " + ", ".join(found).upper()) if a == 1]
            assert ends and ends[0] == len(found) + 1
            k = rng.choice(mandatory)
            broken = [*found[:k], "zz", *found[k + 1 :]]
            pattern = re.compile(_pattern(template))
            want = {1 + line.count(" ") for line in [m[0].rstrip(" ") for m in [pattern.match(" ".join(broken) + " ")] if m]}
            assert {b for a, b in longest(template, " ".join(broken)) if a == 0} == want


def test_scan_equals_patterns_on_random_words(monkeypatch):
    rng = random.Random(6)
    templates = ["a b", "a [[b]] {{x:0-2}} c", "a {{x:1-30}} b b", "b [[a [[c]]]] {{y:2-5}} a c", "c {{z:0-400}} b a b a"]
    for states in (20_000, 3):
        monkeypatch.setattr(ls, "MOST_STATES", states)
        for t in templates:
            ls.compiled.cache_clear()
            for _ in range(30):
                w = rng.choices("abcd", (4, 4, 3, 2), k=rng.randrange(60))
                got = {a: b for a, b in longest(t, " ".join(w))}
                want = {}
                for i in range(len(w)):
                    for j in range(len(w), i, -1):
                        if re.fullmatch(_pattern(t), " ".join(w[i:j]) + " "):
                            want[i] = j
                            break
                assert got == want, (t, w)
    ls.compiled.cache_clear()


def test_long_and_repeated_texts(spark):
    body = ls.TEMPLATES["mit-body"][0].replace("{{holder:1-20}}", "the authors or copyright holders").replace("[[(including the next paragraph)]]", "")
    texts = ["copyright " * 110_000, "x " * 200_000 + body + " y" * 1000, body, body, "permission is hereby granted free " * 20_000]
    got = rows(ls.scan_licenses(docs(spark, texts)))
    assert (got[0]["n_words"], got[0]["labels"]) == (110_000, "")
    assert got[1]["labels"] == got[2]["labels"] == got[3]["labels"] == "mit,mit-body" and got[2]["regions"] == got[3]["regions"]
    assert got[1]["regions"][0].startswith("200000-") and got[4]["labels"] == ""


def test_license_rows(spark):
    texts = [None, "", "All rights reserved. ALL RIGHTS reserved", "Licensed under CC-BY 4.0", "GNU General Public License, version 3", "cc", "general public" + " license" * 2, "copyright (c) Me, all rights reserved é"]
    got = rows(ls.scan_licenses(docs(spark, texts)))
    assert got[0]["n_words"] == got[1]["n_words"] == 0 and got[0]["first_word"] is None and got[0]["labels"] == ""
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["score"]) == (2, 0, 3, 0.5)
    assert (got[3]["base_labels"], got[3]["labels"], got[3]["score"]) == ("cc-by", "cc-by,cc-by-4.0", 1.0)
    assert got[4]["labels"] == "gpl,gpl-3.0" and got[5]["n_base"] == 0 and got[6]["n_base"] == 1
    assert got[7]["labels"] == "copyright,reserved" and got[7]["regions"] == ["0-6"]
    assert ls.scan_licenses(docs(spark, texts).limit(0)).count() == 0


def plain_rules(text):
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_plain_version(spark):
    rng = random.Random(2)
    texts = [None, "", "a " * 40, "x\ny\nx\n \nx", "# a | b"]
    texts += ["\n".join(" ".join(rng.choice("abcdé#") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(12))) for _ in range(40)]
    texts += ["one two three four five six seven eight " * 3 + "tail", texts[-1]]
    got = rows(qr.apply_rules(docs(spark, texts)))
    for i, t in enumerate(texts):
        want = plain_rules(t)
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_frequent_lines(spark):
    body = lambda k: " ".join(chr(97 + k % 26) * (2 + k // 26) + chr(97 + i % 26) * (1 + i // 26) for i in range(30))
    texts = [body(k) + "\nHome | About | Contact!" for k in range(30)] + ["Home about CONTACT\n" + body(99) + "\n" + "home, about: contact " * 1]
    texts += ["HOME ABOUT CONTACT\n" * 9 + "and a few own words here that are not enough to stay at all ok"]
    hosts = ["a"] * 31 + ["a"]
    got = rows(qr.apply_rules(docs(spark, texts + [body(5)] * 3, sources=hosts + [None] * 3)))
    assert got[0]["n_removed_words"] == 5 and got[0]["kept"] and got[30]["n_removed_words"] == 6 and got[30]["kept"]
    assert not got[31]["kept"] and got[33]["kept"] and got[33]["n_removed_words"] == 0
    assert qr.apply_rules(docs(spark, texts).limit(0)).count() == 0
    assert lower("AÉ") == "aÉ"


def plain_lines(texts, hosts):
    """Words of removed lines per row, by sets of texts."""
    import regex

    norm = lambda s: regex.sub(r"[^\p{L}\p{N}]+", " ", regex.sub(r"\p{Nd}", "0", s.lower())).strip(" ")
    lines = [[(norm(s), len(words(s))) for s in (t or "").split("\n") if words(s)] for t in texts]
    held = {}
    for t, h, own in zip(texts, hosts, lines, strict=True):
        for n, _ in own:
            held.setdefault((h, n), set()).add(t or "")
    over = {k for k, v in held.items() if len(v) > (2 if len(k[1].split(" ")) >= 50 else 10)}
    return [sum(w for n, w in own if (h, n) in over) for h, own in zip(hosts, lines, strict=True)]


@pytest.mark.parametrize("small", [10**6, 0])
def test_removed_lines_equal_sets(spark, monkeypatch, small):
    """Shared short and long lines, a host with most rows, many copies; broadcast and joined, with and without splits."""
    monkeypatch.setattr("epsforest.operators.skew.ROWS", 8 if not small else 1024)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    passages = [" ".join(word() for _ in range(n)) for n in (50, 60, 49, 90)]
    short = [f"Menu {k}: Home | {'abcdefgh'[k]}" for k in range(8)]
    texts, hosts = [None, "", "1\n2\n3"], [None, "a", "="]
    for k in range(240):
        own = [" ".join(word() for _ in range(12)) for _ in range(3)]
        own += [rng.choice(short)] * rng.randrange(3) + ([passages[k % 4].upper()] if k % 9 == 0 else [])
        rng.shuffle(own)
        texts.append("\n".join(own))
        hosts.append(("a", "a", "b", None, "")[k % 5])
    texts += [texts[9]] * 40 + ["x " * 100_000 + "\n" + passages[3]]
    hosts += ["a"] * 41
    got = qr.apply_rules(docs(spark, texts, sources=hosts), small=small).orderBy("doc_id").collect()
    want = plain_lines(texts, hosts)
    assert [r["n_removed_words"] for r in got] == want and len({w for w in want if w >= 50}) > 1
    assert all(r["kept"] == (not r["base_failed"] and r["n_left_words"] >= max(20, 0.5 * r["n_words"])) for r in got)
