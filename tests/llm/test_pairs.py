import os

import duckdb
import numpy as np
import pytest

from talkgrid.llm.functions import labels
from talkgrid.llm.functions.answers import VOTES, _SENTENCE, signals
from talkgrid.llm.functions.languages import Languages
from talkgrid.llm.pairs import trained_languages

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def languages():
    if not os.path.isdir(BASE):
        pytest.skip("no test data")
    docs = duckdb.sql(f"SELECT lower(split_part(lang, '-', 1)), text FROM '{BASE}/documents.parquet' WHERE lang IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    return Languages.fit([d for d in docs if d[0] != "und"]), docs


def test_cutoffs_are_those_of_the_sweep(languages):
    """Sound answers are spoiled in known ways; the label model sees none of that, the cutoffs are chosen on it."""
    model, docs = languages
    pairs = duckdb.sql(f"""SELECT DISTINCT question, answer FROM (SELECT DISTINCT example_id, answer FROM '{BASE}/per_example.parquet' WHERE parse_ok AND NOT abstain AND answer IS NOT NULL)
        JOIN (SELECT id, min(question) AS question, min(question_type) AS t FROM '{BASE}/dev_gold.parquet' GROUP BY id) ON id = example_id WHERE t <> 'negative' AND question IS NOT NULL ORDER BY ALL""").fetchall()
    clean = [(q, a) for q, a in pairs if not any(f for f, v in zip(signals(q, a, None, True, None, model), VOTES) if v[2] == 1)]
    others = {}
    for _, a in clean:
        if model.best(a) is not None:
            others.setdefault(model.names[model.best(a)], []).append(a)
    for lang, text in docs:
        if lang in model.names and model.best(text) == model.names.index(lang):
            others.setdefault(lang, []).extend([x.strip() for x in _SENTENCE.split(text) if 8 < len(x.split()) < 30 and x.strip()[-1:] == "."][:3])
    of = lambda q: None if model.best(q) is None else model.names[model.best(q)]
    got = labels.sweep(labels.spoiled(clean, others, of, 0), model)
    for d in labels.DEFECTS:
        assert labels.CUTOFFS[d] == labels.chosen(list(labels.SWEEP[d])) and max(got[d]) >= 0.94
        assert got[d][labels.CANDIDATES.index(labels.CUTOFFS[d])] >= max(got[d]) - 0.02


def test_languages_by_letter_groups(languages):
    model, _ = languages
    en = model.names.index("en")
    assert {"de", "en", "es", "fr"} <= set(model.names) and Languages.fit([]) is None and Languages.fit([("en", "a few words")]) is None
    assert model.differs(en, "Se muestra un judge prompt que primero ordena sus entradas.") and not model.differs(en, "It keeps its cache small and hands the rest to the queue.")
    assert model.unlike("演讲者说数据不再适合内存因此变得更慢并且需要更多的机器来处理这些问题所以他们改变了设计") and not model.unlike("") and not model.differs(None, "le la les")


def fired(q, a, model):
    return {name for (_, name, _), on in zip(VOTES, signals(q, a, None, True, None, model)) if on}


def test_answers_in_further_languages_and_doubled_questions(languages):
    model, _ = languages
    q = "What does the speaker say about the caching policy of the golden set?"
    assert "function_words" in fired(q, "Il discorso dice che la memoria è stata ricostruita perché i dati non erano più completi.", model)
    assert "function_words" in fired(q, "De spreker zegt dat het geheugen wordt vervangen omdat de data niet meer past.", model)
    assert "unlike" in fired(q, "演讲者说数据不再适合内存因此变得更慢并且需要更多的机器来处理这些问题所以他们改变了设计", model)
    assert {"declines"} <= fired(q, "Mi dispiace, non posso rispondere.", model) and "repeats" in fired(q, f"{q} {q}", model)


def test_dependent_functions_count_less():
    # the second function copies the first; the third is independent
    patterns = np.array([[0, 0, 0], [1, 1, 0], [1, 1, 1], [0, 0, 1], [1, 0, 0]])
    counts = np.array([2000, 60, 40, 20, 1])
    one = labels.label_model(patterns[:, [0, 2]], counts, [1, 1])
    both = labels.label_model(patterns, counts, [1, 1, 1])
    assert abs(one[2] - both[2]) < 0.1 and both[0] < 0.05
    linked = labels.dependence(patterns.astype(float), counts.astype(float), both)
    assert linked[0, 1] > 0.8


def test_trained_languages_table(spark):
    rows = [(i, lang, text) for i in range(30) for lang, text in (("en-US", f"the cache of the talk is small {i}"), ("DE", f"der Speicher des Vortrags ist klein {i}"), ("und", "x"), (None, "y"))] + [(99, "en", None)]
    model = trained_languages(spark.createDataFrame(rows, "d int, lang string, t string"), "d", "lang", "t")
    assert model.names == ["de", "en"]
    assert trained_languages(spark.createDataFrame([], "d int, lang string, t string"), "d", "lang", "t") is None
