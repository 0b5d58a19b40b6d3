"""Training-data operators: licences, decontamination, search, mixing, quality, duplicates, chat, token counts and languages."""
