x207