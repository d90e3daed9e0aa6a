x381