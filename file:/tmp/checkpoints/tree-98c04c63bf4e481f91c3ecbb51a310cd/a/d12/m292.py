x292