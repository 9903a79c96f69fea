import re
from collections import Counter

import numpy as np
import pytest

from verdictlab.llm import fertility
from verdictlab.llm.common import tokenizer_path

from .fixtures import ODD_ROWS, SCHEMA, TEXTS, documents

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


MORE = [*TEXTS, "x y z x y z q x y", "a a a a", "#a *b\n#a *b\n \n\n#a *b |<>&%$", "\x85 \xa0 \x1c " * 3, "漢字 かな " * 60, "αβγ δεζ " * 80, "a\x0bb\x0cc\rd"]


def test_base_measures_equal_brute_force(spark):
    docs = documents(spark, MORE, ODD_ROWS).repartition(3)
    got = sorted((r["doc_id"] or -99, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in fertility.fertility_rules(docs, *PATHS).collect())
    assert got == sorted((d or -99, *brute(t)) for d, t, *_ in docs.collect())
    assert fertility.fertility_rules(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0


def test_base_measures_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in fertility.fertility_rules(docs, *PATHS).collect()}
    for d, t, *_ in docs.collect():
        r = rows[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t)


def test_vocabulary_measures_equal_libraries():
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    words = "plain words and 漢字 ꙮ plain".encode().split()
    ids = [i for w in words for i in sp.encode(w.decode())]
    assert fertility.Pieces(PATHS[1], limit=1).counts([words, [], words]) == [(len(ids), sum(map(sp.IsByte, ids))), (0, 0), (len(ids), sum(map(sp.IsByte, ids)))]
    assert fertility.entropy(np.array([1, 1, 2, 3])) == pytest.approx(1.5) and fertility.entropy(np.array([])) == 0


def test_scripts():
    assert [fertility.script_of(x) for x in ("", "12 !", "abc", "été à", "漢字 a", "かなカ", "привет", "123 é")] == ["none", "none", "latin", "latin", "han", "kana", "cyrillic", "latin"]


def test_bands_reject_outliers_and_keep_the_rest(spark):
    words = "alpha beta gamma delta epsilon zeta theta lambda".split()
    clean = [" ".join(f"{words[(i + j) % 8]} {words[(i * j) % 8]} w{(i * 31 + j * 17) % 97}" for j in range(60 + i)) for i in range(80)]
    odd = [" ".join(f"ꙮ{chr(0xA640 + (i * 7 + j) % 40)}ꙮ{j}" for j in range(70)) for i in range(3)]
    rows = {r["doc_id"]: r for r in fertility.fertility_rules(documents(spark, clean + odd), *PATHS).collect()}
    assert [d for d in range(80) if not rows[d]["kept"] and not rows[d]["base_failed"]] == []
    # they are of no listed script, too few for a band of their own
    assert all(rows[80 + i]["byte_fallback"] > 0.5 for i in range(3))


def test_verdicts_equal_brute_force(spark, sf_dir):
    """The bands by numpy's quantiles over the distinct texts of each group, and every verdict by them."""
    import math

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in fertility.measure(docs, *PATHS).collect()]
    got = {r["doc_id"]: r["kept"] for r in fertility.fertility_rules(docs, *PATHS).collect()}
    for r in rows:
        r["octave"] = math.floor(math.log2(r["n_tokens"])) if r["n_tokens"] else 0
    seen, texts = set(), []
    for r in rows:
        if (k := (r["lang"], r["script"], r["text_key"])) not in seen:
            seen.add(k)
            texts.append(r)

    def band(measure, floor, least, **group):
        values = sorted(math.floor(r[measure] * 10_000 + 0.5) / 10_000 for r in texts if r[measure] is not None and all(r[k] == v for k, v in group.items()))
        if len(values) < max(1, least):
            return None
        down = max(0, math.floor(25 - 300 * math.sqrt(0.1875 / len(values)))) / 100
        low, mid, high = np.quantile(values, [down, 0.5, 1 - down])
        width = 3 * (high - low)
        if measure == "byte_fallback":
            return 0.0, max(high + width, mid + 0.1)
        return min(low - width, mid * (1 - floor)), max(high + width, mid * (1 + floor))

    for r in rows:
        kept = not r["base_failed"]
        for m in ("chars_per_token", "byte_fallback", "token_entropy"):
            if r[m] is None:
                continue
            octave = {"octave": r["octave"]} if m == "token_entropy" else {}
            own = band(m, 0, 50, lang=r["lang"], script=r["script"], **octave)
            low, high = own or band(m, 0.4, 50, script=r["script"], **octave) or band(m, 0.4, 1, **octave)
            if own is None and m == "byte_fallback":
                high = min(high, 0.5)
            kept = kept and low - 5e-5 <= r[m] <= high + 5e-5
        assert got[r["doc_id"]] == kept, r
    assert 0 < sum(got.values()) < len(got)


def test_copies_do_not_squeeze_a_band(spark):
    text = " ".join(f"word{i}" for i in range(100))
    other = " ".join(f"another{i} thing{i * 3}" for i in range(60))
    rows = fertility.fertility_rules(documents(spark, [text] * 200 + [other] * 3), *PATHS).collect()
    assert all(r["kept"] for r in rows)


def test_junk_that_passes_the_base_rule_is_rejected(spark):
    words = "the other house is there with some water under every window before morning".split()
    rng = np.random.default_rng(3)
    clean = [" ".join(rng.choice(words, 80 + i)) for i in range(120)]
    junk = [" ".join(w + "%$&*"[rng.integers(4)] * 3 for w in rng.choice(words, 100 + i)) for i in range(5)]
    # copies of one text must not narrow the band of the others
    docs = documents(spark, clean + junk + [clean[0]] * 300)
    rows = {r["doc_id"]: r for r in fertility.fertility_rules(docs, *PATHS).collect()}
    assert not any(rows[120 + i]["base_failed"] for i in range(5))
    assert not any(rows[120 + i]["kept"] for i in range(5))
    assert all(r["kept"] for d, r in rows.items() if not 120 <= d < 125)


def test_no_text_goes_unjudged(spark):
    words = "alpha beta gamma delta epsilon zeta theta lambda".split()
    clean = [" ".join(f"{words[(i + j) % 8]} {words[(i * j) % 8]} w{(i * 31 + j * 17) % 97}" for j in range(60 + i)) for i in range(80)]
    odd = [" ".join(f"ꙮ{chr(0xA640 + (i * 7 + j) % 40)}ꙮ{j}" for j in range(70)) for i in range(3)]
    # beside many others, and alone in a table too small for any band of MIN_DOCS
    for texts in (clean + odd, clean[:4] + odd, odd):
        rows = {r["doc_id"]: r for r in fertility.fertility_rules(documents(spark, texts), *PATHS).collect()}
        n = len(texts) - 3
        assert not any(rows[n + i]["base_failed"] or rows[n + i]["kept"] for i in range(3))
        assert all(rows[i]["kept"] for i in range(n))
