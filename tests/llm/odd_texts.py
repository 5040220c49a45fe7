"""Texts at which cutting at spaces could go wrong."""

ODD = ["", " ", "  ", "a  b", "a \n b", "a\n \n b", "\n\nfoo", "foo ", "foo  ", "it's we'll 'x", "x\t y", "a\x85b \xa0c", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>c ", "日本語 テキスト", "🙂🙂 é́ ñ", "x" * 5000, "ab " * 300, "1234 567.89", "a\x1cb \x1d c", "\x00foo \x00foo foo", "a\n b\n\n c", "e 　 f  g"]
