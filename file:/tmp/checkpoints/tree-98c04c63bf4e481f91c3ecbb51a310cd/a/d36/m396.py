x396