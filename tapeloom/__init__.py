"""tapeloom: DataFrame operators for archives of long recordings and their embeddings."""
