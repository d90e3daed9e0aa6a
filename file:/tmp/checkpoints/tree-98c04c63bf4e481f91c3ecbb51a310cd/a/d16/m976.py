x976