"""Letters, out-of-place distances by hand, and labels in several passes."""

from collections import Counter

import pytest

from palisade.llm import language

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and runs home with the others", "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft heim",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et rentre chez lui", "hi": "तेज़ भूरी लोमड़ी आलसी कुत्ते के ऊपर से कूदती है और घर जाती है", "xx": "aaa bbb ccc ddd",
}


@pytest.mark.parametrize("text, want", [
    ("²³", ""), ("½", ""), ("Ⅷ", ""), ("́", ""), ("12 34 !!", ""), ("_", ""), ("हिन्दी में", " हिन्दी में "), ("Ab_c 12é", " ab c é "), ("éa", " éa "), ("ʰ x²y", " ʰ x y "),
])
def test_letters(text, want):
    assert language.letters(text) == want


def grams(text):
    words = "".join(c if c.isalpha() or "ऀ" <= c <= "ॣ" else " " for c in text.lower()).split()
    line = f" {' '.join(words)} " if words else ""
    # The stretch ends with its last space, which begins no longer gram.
    return Counter(g for i in range(len(line)) for n in (1, 2, 3) if len(g := line[i : i + n]) == n and g != " ")


def ranked(counts, top):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * (len(x[0]) - 1 - k) for k, c in enumerate(x[0]))))][:top]


@pytest.mark.parametrize("per_pass", [1, 2, 2000])
def test_distances_by_hand(spark, per_pass):
    top, rows = 40, []
    taught = {n: lang for n, lang in enumerate(TEXTS)}
    free = [i for i in range(200) if not is_held_out(i)]
    for k, (n, lang) in enumerate(taught.items()):
        rows.append((free[k], TEXTS[lang], lang))
    asked = [i for i in range(200) if is_held_out(i)]
    for k, text in enumerate([*TEXTS.values(), "the dog", "den Hund", "घर", "²³", None, "", "aaa", "the dog der Hund"]):
        rows.append((asked[k], text, "en"))
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), top=top, languages_per_pass=per_pass).collect()}
    known = {lang: ranked(grams(TEXTS[lang]), top) for lang in TEXTS}
    for doc_id, text, _ in rows:
        own = ranked(grams(text or ""), top)
        if not own:
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
            continue
        away = sorted((sum(abs(p.index(g) - i) if g in p else top for i, g in enumerate(own)), lang) for lang, p in known.items())
        assert got[doc_id].lang_pred == away[0][1], text
        assert got[doc_id].score == pytest.approx((away[1][0] - away[0][0]) / away[1][0] if away[1][0] else 0.0)


def is_held_out(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 3 == 1
