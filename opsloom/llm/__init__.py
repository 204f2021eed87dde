"""Operations for training-data pipelines: near duplicates, licences, repeats, token files, decontamination, quality, archives, packing, toxicity, personal data."""
