"""Words that hashes by polynomials modulo 2**64 confuse."""


def thue_morse_words(letters: str = "ab", doublings: int = 12) -> tuple[str, str]:
    """Two words in two letters in the order of Thue and Morse, one with the letters exchanged."""
    a, b = letters
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b
