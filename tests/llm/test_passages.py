import random

from causalnet.llm import substring


def test_case_folds_beside_other_letters(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = f"The {text(30)} and Then {text(30)}"
    rows = [(1, f"{text(40)}. {passage}. {text(40)}"), (2, f"Café {text(40)}. {passage.upper()}. {text(40)}"), (3, text(100))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {q["doc_id"] for q in got.where("removed").collect()} == {2}


def test_passages_of_50_words_are_found_whole_wherever_they_start(spark):
    r = random.Random(12)
    words = [f"u{i}" for i in range(5000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, whole = [], {}
    for k in range(60):
        passage = text(r.choice([50, 51, 60, 120]))
        for i in (2 * k, 2 * k + 1):
            before = text(r.randint(25, 90)) + f" x{i} "
            rows.append((i, before + passage + f" y{i} " + text(60)))
            whole[i] = (len(before), len(before) + len(passage))
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {q["doc_id"]: (q["start"], q["end"]) for q in got} == whole and len(got) == 120
