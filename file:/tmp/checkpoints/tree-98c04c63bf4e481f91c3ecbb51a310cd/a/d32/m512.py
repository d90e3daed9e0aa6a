x512