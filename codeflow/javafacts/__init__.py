"""Facts of Java sources: a tolerant lexer and declaration parser, run by ``extract`` over a files DataFrame."""
