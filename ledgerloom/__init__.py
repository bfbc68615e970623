"""Statement ledgers from positioned words, as lazy DataFrame plans."""
