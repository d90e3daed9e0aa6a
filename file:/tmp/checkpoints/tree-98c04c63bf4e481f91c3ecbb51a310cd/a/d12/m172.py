x172