"""Runs of letters, found at a cost that does not hang on the many number characters."""

import random
import re
import sys
import time
import unicodedata

from skuforge.llm import langid


def test_runs_are_those_of_the_definition():
    numbers = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and unicodedata.category(c) in ("Nl", "No")]
    whole = re.compile(rf"[^\W\d_{re.escape(''.join(numbers))}]+")
    pool = [*"abz09_ -\n", *"éßжщ中あ한ع", "́", "\U0001f600", "\U00020000", "\U0001d400", *random.Random(1).sample(numbers, 60), "½", "Ⅷ", "\U00010107", "\U0001f101"]
    some = random.Random(2)
    texts = ["".join(some.choices(pool, k=some.randrange(60))) for _ in range(2_000)] + ["", "plain words", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20200)]))]
    assert all(langid.letter_runs(t) == whole.findall(t) for t in texts)


def test_text_that_is_not_ascii_is_scanned_fast():
    text = "Çà et là, le café était fermé \U0001f600 depuis l'été dernier. " * 4_000
    best = min(_seconds(langid.letter_runs, text) for _ in range(3))
    # one class of letters without the numbers takes some ten times as long as letters alone
    assert best < 4 * min(_seconds(re.compile(r"[^\W\d_]+").findall, text) for _ in range(3))


def _seconds(f, text):
    begin = time.process_time()
    f(text)
    return time.process_time() - begin
