x943