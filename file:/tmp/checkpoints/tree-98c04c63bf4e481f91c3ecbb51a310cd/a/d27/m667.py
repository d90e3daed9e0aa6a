x667