x901