from __future__ import annotations

import os

import pytest

import heldout
from sigloom.llm import abuse
from sigloom.llm.spelling import _one_slip, clauses, folded, letter_by_letter, pieces, plain, tokens_of

G = abuse.grammar()


def score(text):
    return G.document(text)[0]


@pytest.mark.parametrize(
    "text",
    [
        "You are a complete idiot.",
        "you st0pid m0r0n, go away",
        "only an a**hole would write this",
        "I will smash your face if it fails again",
        "Nobody would miss you if you were gone.",
        "kill yourself",
        "k i l l   y o u r s e l f you s.c.u.m.b.a.g",
        "Halt die Fresse, du Drecksack",
        "Ferme ta gueule, connard",
        "Eres un gilipollas, lárgate del proyecto",
        "Immigrants are vermin and should be driven out of the country",
        "women belong in the kitchen",
        "Die Ausländer stinken und stehlen, raus mit ihnen",
        "send me nudes, I want to see your tits",
        "she moaned louder with every thrust",
        "yоu are an іdіоt and you know it",
        "you id​iot, you",
        "long log line ok\nall fine here\n" * 50 + "you worthless piece of shit",
        "<x> \x1b[31mshut up, dickhead\x1b[0m",
        "yóú ídiot",
        "去死吧",
        "死ね",
    ],
)
def test_found(text):
    assert score(text) >= abuse.THRESHOLD, text


@pytest.mark.parametrize(
    "text",
    [
        "",
        "   \n\t ",
        "please kill the child process before the parent",
        "the master node waits until every slave has reported",
        "what a mess, this shitty makefile never tells you which rule failed",
        "damn, that took three hours",
        "this parser is garbage and the patch is terrible",
        "I was an idiot, the flag was missing in my own profile",
        "I am such an idiot",
        "our rules forbid hate speech and pornographic pictures",
        "removed one insulting comment from the thread and reminded everyone of the rules",
        "cocktail_sort and assemble_class collide; bastard_insert() is fine",
        "Scunthorpe, Essex, Dickinson and the analyst's class pass",
        "a dumb terminal without colour support",
        "strip leaves a naked pointer table behind",
        "the male connector does not fit the female header",
        "so ein Mist, der Linker hat wieder Symbole verloren",
        "0xdeadbeef 5h17 a55e7 b00b5",
        "it is enough to push the list before you bind the batch",
        "nobody has confirmed the licence after a retart",
    ],
)
def test_not_found(text):
    assert score(text) < abuse.THRESHOLD, text


def test_kinds():
    assert G.document("you are a moron")[1] == "abusive"
    assert G.document("the foreigners are a disease")[1] == "hateful"
    assert G.document("looking for a blowjob")[1] == "sexual"
    assert G.document("all is well") == (0.0, "", 0)


def test_negation_reports_and_self_mockery_lower_the_score():
    assert score("you are not an idiot") < score("you are an idiot")
    assert score("the comment you reported called you an idiot, which our rules forbid") < abuse.THRESHOLD
    assert score("i am a complete idiot") < abuse.THRESHOLD


def test_isolated_words_score_low():
    assert score("idiot") < abuse.THRESHOLD and score("the stupid thing") < abuse.THRESHOLD


def test_spelling():
    assert plain("Straße Ã© \x1b[1mX\x1b[0m") == "strasse e x"
    assert folded("stuuupiid") == "stupid"
    assert _one_slip("imbecile", "imbecille") and _one_slip("moron", "mroon") and not _one_slip("batch", "bitch") and _one_slip("scumbag", "scumbeg")
    assert list(clauses("a b. c d!\ne")) == ["a b.", "c d!", "e"]
    assert letter_by_letter(tokens_of("b a s t a r d")) and not letter_by_letter(tokens_of("plan a or b"))
    assert G.lexicon.read("m0r0n").keys() >= {"INSULT"} and not G.lexicon.read("08f1c2d3")


def test_very_long_text_is_read_to_the_end():
    assert score("x " * 200_000 + ". you are a moron") >= abuse.THRESHOLD
    assert score("a" * 1_000_000) == 0
    assert score("b " * 100_000) == 0


def test_column(spark):
    rows = [(1, None), (2, ""), (3, "you moron"), (3, "you moron"), (None, "fine")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as `score.x`")
    got = abuse.score(df, "text").select("doc_id", "abuse.*").collect()
    assert sorted((r["doc_id"] or 0, r["score"] >= abuse.THRESHOLD) for r in got) == [(0, False), (1, False), (2, False), (3, True), (3, True)]
    assert abuse.score(df.limit(0), "text").count() == 0
    clash = abuse.score(df.withColumnRenamed("doc_id", "abuse"), "text")
    assert clash.columns == ["abuse", "text", "score.x"] and clash.select("abuse.score").count() == 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_against_reviewers():
    """Labels hold errors; both rates are bounded with room for them."""
    import pyarrow.parquet as pq

    docs = dict(zip(*(pq.read_table("/root/testdata/sf0.01/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))
    labels = pq.read_table("/root/testdata/sf0.01/review_labels.parquet")
    said = [(d, x.strip().lower() != "none") for d, x in zip(labels.column("doc_id").to_pylist(), labels.column("label").to_pylist()) if x and docs.get(d)]
    hits = {d: score(docs[d]) >= abuse.THRESHOLD for d, _ in said}
    bad = [d for d, yes in said if yes]
    assert sum(hits[d] for d in bad) >= 0.75 * len(bad)
    assert sum(hits[d] for d, yes in said if not yes) <= 0.05 * len(said)


@pytest.mark.parametrize("text", ["you are a half-wit", "you nit-wit", "what a douche-bag", "you are an arse-hole", "fuckyou", "you cu nt", "you mo/ron", "you fuc kyou", "you son of a bi.tch"])
def test_cut_hyphenated_and_merged_words_reach_the_machines(text):
    assert score(text) >= abuse.THRESHOLD, text


def test_no_clause_is_passed_over_that_the_lattice_reads():
    """What decides whether a clause is read at all holds every symbol that its lattice holds."""
    words = sorted(w for w in G.lexicon.words if w.isalpha() and len(w) > 2)[::25]
    spelt = [f"{a}{w[:k]}{sign}{w[k:]}{b}" for w in words for k in range(len(w)) for sign in (" ", "-", "/", "_", ". ") for a, b in (("you ", ""), ("you are a ", " you"))]
    spelt += [f"{a}{w}{b}" for w in words for a, b in (("you", ""), ("", "you"), ("you are a stupid", ""), ("yo u", ""), ("", "y ou"), ("yo ", "u"))]
    lost = []
    for t in spelt:
        held = 0
        for _, _, symbols in G.lexicon.lattice(t)[1]:
            held |= G._bits(symbols)
        if held & ~G.mask(t):
            lost.append(t)
    assert lost == []


@pytest.mark.parametrize(
    "text",
    [
        "your comment proves you are a moron and I will have you removed",
        "this comment proves you are a moron and I will have you removed",
        "I removed your comment because you are a moron",
        "policy and rules say what they like, report me if it helps, you are a worthless idiot",
        "the foreigners are a disease and that is all I have to say in this long line without any sign of an end, the report on the policy is another matter",
    ],
)
def test_report_words_far_off_or_beside_a_direct_insult_do_not_count(text):
    assert score(text) >= abuse.THRESHOLD, text


@pytest.mark.parametrize("text", ["removed a comment that said you are an idiot under the rules", "the policy explains that you are an idiot is an insult", "the report on the policy quoted the foreigners are a disease as a case", "blocked by our rules: the comment you are an idiot"])
def test_report_words_near_a_quotation_count(text):
    assert score(text) < abuse.THRESHOLD, text


@pytest.mark.parametrize(
    "text",
    [
        "you are a\nworthless idiot",
        "I think that you\nare\na complete\nmoron and so on",
        "> you are a\r\n> worthless idiot",
        " * fine. you are a\n * worthless idiot. fine",
        "All is well, and this line is long\nenough to be cut; I will smash\nyour face if it fails",
        "yóu are a\nwörthless \"\nidiot",
        "this runs on\n" * 400 + "and you are a\nmoron\n" + "that runs on\n" * 400,
    ],
)
def test_sentences_wrapped_over_lines_are_read_whole(text):
    assert score(text) >= abuse.THRESHOLD and G.document(text)[2] == 1, text


@pytest.mark.parametrize("text", ["thank you.\nidiot", "you\n\nidiot", "it is all up to you\nMoron is a town in Argentina", "\n", "a\n", "\n\na", "you;\n idiot"])
def test_ended_lines_are_not_joined(text):
    assert score(text) < abuse.THRESHOLD, text


def test_pieces_of_long_runs_share_words_and_parts():
    parts = [f"w{i} x" for i in range(1000)]
    got = [p.split() for p in pieces(parts)]
    assert len(got) > 2 and all(set(a[-128:]) == set(b[:128]) for a, b in zip(got, got[1:])) and {w for p in got for w in p} == {w for p in parts for w in p.split()}
    long = [" ".join(["w"] * 600)] * 3
    assert [len(p.split()) for p in pieces(long)] == [1200, 1200]


def test_words_cut_by_a_line_end_are_read():
    for text in ("here and there in this quite long line you mor\non and so on in the other long line", "you are a half-\nwit", "b\na\ns\nt\na\nr\nd you are", "you fuc\nkyou"):
        assert (score(text) >= abuse.THRESHOLD) == (G.clause(text.replace("\n", " "))[0] >= abuse.THRESHOLD), text
    assert score("you mor\non") >= abuse.THRESHOLD


def test_held_out_sentences():
    """Sentences in five languages, committed before the grammars; see there why they are no independent measure."""
    bad, fine = ([t for listed in x.values() for t in listed] for x in (heldout.ABUSIVE, heldout.HARMLESS))
    assert len(bad) >= 100 and len(fine) >= 100 and len(heldout.ABUSIVE) == len(heldout.HARMLESS) == 5
    assert sum(score(t) >= abuse.THRESHOLD for t in bad) >= 0.9 * len(bad)
    assert sum(score(t) >= abuse.THRESHOLD for t in fine) <= 0.02 * len(fine)


def test_fresh_sentences_are_found_as_measured():
    """Written after the grammars: the figures that the README states, neither better nor worse."""
    assert sum(score(t) >= abuse.THRESHOLD for t in heldout.FRESH_ABUSIVE) == 16 and len(heldout.FRESH_ABUSIVE) == 30
    assert sum(score(t) >= abuse.THRESHOLD for t in heldout.FRESH_HARMLESS) == 3 and len(heldout.FRESH_HARMLESS) == 30


@pytest.mark.parametrize(
    ("bare", "inside"),
    [
        ("you are an idiot", "you are not an idiot"),
        ("you are a fool", "nobody here thinks you are a fool"),
        ("the maintainer is a moron", "the word moron is on the list"),
        ("you stupid bitch", "he was banned because he called her a stupid bitch"),
        ("immigrants are vermin", "it is said that nobody should call immigrants vermin"),
        ("you are an idiot", 'the test "you are an idiot" checks the filter'),
        ("kappel is an idiot", "i am an idiot"),
        ("i hate you", "i hate you, makefile"),
        ("his boss is a real bastard", "this bug is a real bastard"),
    ],
)
def test_context_transducers_lower_the_score(bare, inside):
    assert score(bare) >= abuse.THRESHOLD > score(inside)


def test_machines_are_composed_of_fields():
    """No machine is a sentence: every one reads a semantic field or a phrase, or a few words that mean only this."""
    for m in G.machines:
        words = [s.symbols for s in m.steps if s.symbols and not s.optional]
        assert sum(all(x[0] == "=" for x in w) for w in words) <= 4, m.pattern


@pytest.mark.parametrize(
    "text",
    ["You're a waste of a human being.", "Do everyone a favour and swallow some bleach.", "what a pathetic little man you are", "Gays are sick perverts who should not be near children.", "These foreigners steal our jobs.", "I will hunt you down and slit your throat.", "Deine Mutter ist eine Hure.", "T'es con ou quoi ?", "Eres un inútil de mierda.", "Ti ammazzo, figlio di puttana.", "My cock is throbbing for you.", "你是白痴"],
)
def test_other_wordings_are_found(text):
    assert score(text) >= abuse.THRESHOLD, text


@pytest.mark.parametrize(
    "text",
    ["The parser is a piece of shit, I had to rewrite it.", "I'd kill for that feature.", "The drop dead date is Monday.", "You lucky bastard, it works on your machine.", "The police arrested a man who killed his wife.", "Los procesos zombi deben morir.", "Stupid me, I pushed to the wrong branch.", "He is a lazy evaluator fan.", "Je vais te montrer la figure 3.", "The male and female voices are sampled at night."],
)
def test_other_harmless_wordings_are_not_found(text):
    assert score(text) < abuse.THRESHOLD, text
