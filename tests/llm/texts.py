"""Made-up prose for the tests."""

import zlib

WORDS = "the of and to in a is that it for was on as with by at from this be have".split()


def sentence(seed: int, n: int = 12) -> str:
    words = [WORDS[zlib.crc32(f"{seed}-{i}".encode()) % len(WORDS)] if i % 3 == 0 else f"w{zlib.crc32(f'{seed}/{i}'.encode()) % 5000}" for i in range(n)]
    return " ".join(words).capitalize() + "."


def prose(seed: int, sentences: int = 12) -> str:
    return " ".join(sentence(1000 * seed + i) for i in range(sentences))
