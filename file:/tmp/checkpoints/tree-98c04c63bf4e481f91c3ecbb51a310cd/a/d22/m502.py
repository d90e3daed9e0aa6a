x502