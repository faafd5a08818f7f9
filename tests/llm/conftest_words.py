import random

WORDS = "the of and attion nt er sh in the and is an anly hedre thou".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeghinorst") for _ in range(rng.randint(2, 8))) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.05 else ". " if rng.random() < 0.1 else " ") for w in words).strip()
