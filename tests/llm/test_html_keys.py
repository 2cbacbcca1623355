"""op5's keys of words: each (path, word) is hashed once while it is held, and pages give the tokens they gave."""

from collections import Counter

from riskops.llm import html

PAGES = [f"<div class='q1'><p>uno dos uno</p><p>dos {i}</p> tail</div>" for i in range(6)]


def test_a_word_is_hashed_once(monkeypatch):
    real, asked = html.key, []
    monkeypatch.setattr(html, "key", lambda path, word="": asked.append((path, word)) or real(path, word))
    keys = html.Keys()
    for text in PAGES:
        for path, count in html.words_of(html.elements(text)[1]).items():
            assert [*keys.of(path, count)] == [real(path, w) for w in count]
    assert sorted(asked) == sorted({("/div.q0/p", w) for w in ["uno", "dos", *map(str, range(6))]} | {("/div.q0", "tail")})


def test_held_keys_have_a_bound(monkeypatch):
    monkeypatch.setattr(html, "KNOWN_KEYS", 10)
    keys = html.Keys()
    for i in range(100):
        assert [*keys.of("/p", Counter([f"w{i}", "same"]))] == [html.key("/p", f"w{i}"), html.key("/p", "same")]
        assert keys.held <= 12


def test_words_and_tokens_of_a_page():
    paths, nodes = html.elements(PAGES[3])
    assert html.words_of(nodes) == {"/div.q0/p": Counter(uno=2, dos=2, **{"3": 1}), "/div.q0": Counter(["tail"])}
    assert html.tokens_of(paths, nodes) == {"/div.q0": (1, 20), "/div.q0/p": (2, 16), "": (1, 20)}
