x266