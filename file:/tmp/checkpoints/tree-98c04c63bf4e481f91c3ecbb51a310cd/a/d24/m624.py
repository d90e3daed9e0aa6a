x624