x849