x810