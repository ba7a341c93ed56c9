"""Training-data operators: language, licences, search, leaks, duplicates, tokens, chats, private data and secrets."""
