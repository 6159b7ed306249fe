import random

from tillroll.llm import decontaminate


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.reworded for r in decontaminate.contaminated(docs, bench).collect()}


def test_names_that_begin_sentences_are_placeholders(spark):
    item = "Tom has 3 apples. Tom buys 4 more. How many apples does Tom have?"
    texts = [
        "Ann has 7 apples. Ann buys 5 more. How many apples does Ann have?",
        "Élodie has 7 apples. Élodie buys 5 more. How many apples does Élodie have?",
        "Ann has 7 apples. Tom eats 5 pears. How many apples did Ann have?",
        item,
    ]
    assert found(spark, texts, [item]) == {(0, 0): True, (1, 0): True, (3, 0): False}


def test_fillers_may_fall_together_and_clashes_cost_windows_only(spark):
    item = (
        "Then the farmer picked 3 baskets of pears and carried 5 crates of plums to the market in the old town, "
        "where the baker paid 20 dollars for the pears and the cook paid 3 dollars for the plums before the rain began"
    )
    same = item.replace("3 baskets", "4 baskets").replace("5 crates", "4 crates").replace("3 dollars", "4 dollars")
    torn = item.replace("3 baskets", "4 baskets")
    assert found(spark, [same, torn, item], [item]) == {(0, 0): True, (1, 0): False, (2, 0): False}


def test_copies_of_short_items_are_found(spark):
    items = ["What is the capital city of the old kingdom?", "Name the largest inland sea", "Where do 12 of 30 13 17 19 23 29 31 lie?"]
    texts = [
        "The quiz asks, \"What is the capital city of the old kingdom?\" and more",
        "one (“Name the largest inland sea”) two",
        "so Where do 12 of 30 13 17 19 23 29 31 lie? here",
        "What is the name of the largest sea",
    ]
    assert found(spark, texts, items) == {(0, 0): False, (1, 1): False, (2, 2): False}


def test_shared_instructions_find_nothing(spark):
    """300 items and 300 other documents with one instruction of 17 words."""
    said = "Read the following question with care and then write down only the final answer without any words"
    def words(n, seed):
        dice = random.Random(seed)
        return " ".join("".join(dice.choices("abcdefgh", k=6)) for _ in range(n))
    items = [(f"q{i}", f"{said}: {words(14, i)}.") for i in range(300)]
    docs = [(i, f"{words(20, 1000 + i)}. {said}: {words(30, 5000 + i)}.") for i in range(300)]
    docs += [(900, f"Some text. {items[7][1]} More text."), (901, f"{said}: {words(14, 9)[:-1]}x.")]
    benchmark = spark.createDataFrame([(int(i[1:]), t) for i, t in items], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(900, 7), (901, 9)}


def test_equal_items_are_all_found(spark):
    text = "The train leaves the old station at nine and reaches the harbour before noon on most days of summer."
    benchmark = spark.createDataFrame([(i, text) for i in range(4)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Well. {text} Yes."), (2, text.lower()), (3, "Nothing here at all.")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(d, i) for d in (1, 2) for i in range(4)}
