from .bytes import byte_len, has_border, occurrences, overlap_pattern, regex_quote, successor, utf8  # noqa: F401
