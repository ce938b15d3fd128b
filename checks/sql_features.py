"""The whole path from captions is sequential (sentences, windows); it is tested against a plain version instead."""

SQL: dict[str, str] = {}
