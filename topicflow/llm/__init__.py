"""Training-data operators: licences, language-model scores, duplicates, packing, search, placement,
decontamination, toxicity and page extraction. Nothing outside this package imports it."""
