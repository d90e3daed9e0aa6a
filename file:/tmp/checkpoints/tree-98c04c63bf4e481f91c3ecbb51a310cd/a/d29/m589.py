x589