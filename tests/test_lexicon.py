import pickle

from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.functions.lexicon import LEAST, Lexicon, allowed, deletions, distance, fold, forms

LEX = Lexicon([(1, ["Drying ovens", "Trockenschränke"]), (2, ["CO2 incubators", "CO₂-Inkubatoren"]), (3, ["Number of channels"]), (4, ["Chamber volume", "Innenraumvolumen"]), (5, ["Net weight"])])


def test_spellings():
    for text, ref in {
        "drying ovens": 1, "Dying oven": 1, "ovens, Drying": 1, "All Drying  ovens (14)": 1, "NEW: Drynig_ovens »": 1, "Trockenschraenke": 1, "TROCKENSCHRÄNKE": 1, "Laboratory > Drying ovens | Products": 1, "CO₂-Inkubatooren": 2,
        "incubators, CO2 & accessories": 2, "No. of channels": 3, "Innenraumvol.n": 4, "vol., Chamber": 4, "Net wt. [approx.]": 5, "Our Our ovens, Drying": 1,
    }.items():
        assert LEX.find(text)[0] == ref, text


def test_misses():
    for text in ("Coffee machines", "Careers", "", "???", "x" * 5000):
        assert LEX.find(text)[0] == -1, text


def test_nearer_then_more_used_then_lower_id():
    ties = Lexicon([(7, ["abcdef"]), (8, ["abcdeg"])], {8: 5})
    assert ties.find("abcdeh")[0] == 8
    assert Lexicon([(7, ["abcdef"]), (8, ["abcdeg"])]).find("abcdeh")[0] == 7


def test_pickles():
    assert pickle.loads(pickle.dumps(LEX)).find("Dying oven") == LEX.find("Dying oven")


def _plain(a, b):
    """Damerau-Levenshtein distance over all prefixes, each edit 1."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=8), st.text("abc", min_size=1, max_size=8), st.integers(0, 4))
def test_distance_and_shared_deletions(a, b, most):
    plain = _plain(a, b)
    assert (distance(a, b, most) < float("inf")) == (plain <= most)
    if plain <= most:
        assert LEAST * plain <= distance(a, b, most) <= plain
    if plain <= 2:  # what is within two edits shares a text of up to two deletions each
        cut = lambda x: deletions(x, 0) | deletions(x, 1) | deletions(x, 2)
        assert cut(a) & cut(b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=20), min_size=1, max_size=12, unique=True), st.text("abcd", min_size=1, max_size=20), st.data())
def test_lookup_is_that_of_comparing_with_every_key(names, query, data):
    """Names longer than the indexed beginning too; half of the queries are edited names."""
    if data.draw(st.booleans()):
        query = list(data.draw(st.sampled_from(names)))
        for _ in range(data.draw(st.integers(0, 4))):
            query.insert(data.draw(st.integers(0, len(query))), data.draw(st.sampled_from("abcd")))
            del query[data.draw(st.integers(0, len(query) - 1))]
        query = "".join(query) or "a"
    lexicon = Lexicon(list(enumerate([n] for n in names)))
    expected = min(((d, 0, ref) for key, ref in lexicon.keys.items() if (d := distance(query, key, min(allowed(len(query)), allowed(len(key))))) < float("inf")), default=None)
    assert lexicon.near(query) == expected


def test_fold_and_forms():
    assert fold("Écran_tactile ") == "ecran tactile" and fold("Größe", True) == "groesse"
    assert "magnetic stirrers" in forms("stirrers, Magnetic, benchtop")
