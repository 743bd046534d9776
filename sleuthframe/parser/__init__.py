"""Reading Ruby sources to trees."""
