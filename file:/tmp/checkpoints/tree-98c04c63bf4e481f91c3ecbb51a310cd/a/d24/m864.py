x864