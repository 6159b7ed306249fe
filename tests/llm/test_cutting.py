import random

import public_tokenizers

from tillroll.llm import bpe

PATTERN = public_tokenizers.PATTERN


def test_plain_pattern_cuts_like_the_whole_one():
    dice = random.Random(3)
    odd = [chr(c) for c in (*range(0x180), 0x660, 0x1680, 0x180E, 0x2009, 0x2028, 0x3000, 0x4E00, 0xFEFF, 0x1D7D8, 0x1F600)]
    whole, cut = bpe.split_pattern(PATTERN), bpe.Cutter(PATTERN)
    assert bpe.plain_pattern(PATTERN) is not None
    for _ in range(3000):
        text = "".join(dice.choice(odd) if dice.random() < 0.4 else dice.choice(" a1'st \n\t.lé") for _ in range(dice.randint(0, 25)))
        assert cut.findall(text) == whole.findall(text)
    assert bpe.plain_pattern(r"\p{Lu}+|.") is None and bpe.plain_pattern(r"(?i:a)|.") is None
