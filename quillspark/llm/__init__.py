"""Operations that prepare text for language-model training, each a Spark job of its own."""
